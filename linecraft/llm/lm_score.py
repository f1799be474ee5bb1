"""LM scoring: a gated recurrent language model with a class-factored softmax, in numpy.

Tokens of a text: its words (A-Z folded, split at ASCII white space), then one end token. A
word is known by a 64-bit hash. The open vocabulary is split in two. The ``VOCABULARY`` most
frequent training tokens are outputs of the network; every other token, seen or not, falls in
one of ``BUCKETS`` further outputs by its first two bytes, whose probability is shared among
its tokens by their counts: (c + 0.1) / (sum over the bucket's tokens, one unseen included).
So the probabilities of all tokens still add up to one.

Network: embedding -> gated recurrent unit -> softmax over classes of outputs, then over the
outputs of the class. Classes are runs of about equal probability in frequency order. Biases
start at the log frequencies, so training begins at the unigram model and adds context.

Training: counts of every token come from all training documents (a shuffle). For the network
every training document gives all its windows of ``WINDOW`` tokens, the last partial one
included, so every token of the training text is learned from once. Each scan task trains a copy
on its own windows by backpropagation truncated to a window, and copies are averaged, weighted
by their windows, on the executors; ``ROUNDS`` rounds over different documents, all of them in one.

Scoring: documents of similar length run side by side; the state is carried from window to
window through the whole document. Counts of the ``TABLE`` most frequent tokens come with the
network (sizes fixed by parameters); those of all others are found by a join on the token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm.common import materialise, remainder, row_key
from linecraft.llm.hashing import FOLD, hash_words

VOCABULARY = 1024
BUCKETS = 48
TABLE = 1 << 19
CLASSES = 24        # of about equal probability, before
CLASS_TOKENS = 40   # larger ones are cut
EMBED = 8
HIDDEN = 12
WINDOW = 32
ROUNDS = 2
BATCH = 48
RATE = 0.005
END = np.uint64(0x9E3779B97F4A7C15)  # hash of the end token

_CHARS = 1 << 19
_TILE = 32   # rows of one class in a product
_ROWS = 2048  # rows of a softmax that stay in the cache


def tokenise(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts one after another, their buckets, and tokens per text."""
    hashes, buckets, sizes, some, held = [], [], [], [], 0
    for k, text in enumerate(texts):
        some.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(some[-1])
        if held < _CHARS and k + 1 < len(texts):
            continue
        raw = b" ".join(some) + b" "
        w, start, end = hash_words(raw)
        buf = np.frombuffer(raw, np.uint8)
        two = FOLD[buf[start]] * np.uint64(37) + np.where(end - start > 1, FOLD[buf[start + 1]], np.uint64(0)) \
            if len(w) else w
        size = np.diff(np.searchsorted(start, np.cumsum([len(r) + 1 for r in some])), prepend=0)
        at = np.cumsum(size)  # an end token goes behind each text
        hashes.append(np.insert(w, at, END))
        buckets.append(np.insert((two % np.uint64(BUCKETS)).astype(np.int32), at, 0))
        sizes.append(size + 1)
        some, held = [], 0
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(buckets), np.concatenate(sizes)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, bucket, c) over all texts; counted in each batch first, then by a shuffle."""
    def run(batches):
        for b in batches:
            h, bucket, _ = tokenise(b["text"].to_pylist())
            token, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(bucket[first]), pa.array(n)],
                                             ["token", "bucket", "n"])

    return docs.select("text").mapInArrow(run, "token long, bucket int, n long").groupBy("token").agg(
        F.min("bucket").alias("bucket"), F.sum("n").cast("long").alias("c"))


@dataclass
class Net:
    """Parameters by name, and the tables that follow from the outputs."""
    p: dict
    first: np.ndarray   # first output of each class, and the number of outputs
    of: np.ndarray      # class of each output


def new_net(counts: np.ndarray, seed: int = 5) -> Net:
    """A network whose outputs have the given masses (all above 0), in falling order at best."""
    n = len(counts)
    share = counts / counts.sum()
    part = np.minimum((np.cumsum(share) - share) * CLASSES, CLASSES - 1).astype(int)
    inside = np.arange(n) - np.searchsorted(part, part)
    _, of = np.unique(part * n + inside // CLASS_TOKENS, return_inverse=True)
    k = of[-1] + 1
    first = np.append(np.searchsorted(of, np.arange(k)), n)
    rng = np.random.default_rng(seed)
    mass = np.bincount(of, share)

    def scaled(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)

    p = {"E": scaled(n, EMBED), "W": scaled(3 * HIDDEN, EMBED), "U": scaled(3 * HIDDEN, HIDDEN),
         "b": np.zeros(3 * HIDDEN, np.float32),
         "C": np.zeros((k, HIDDEN), np.float32), "cb": np.log(mass).astype(np.float32),
         "O": np.zeros((n, HIDDEN), np.float32), "ob": np.log(share / mass[of]).astype(np.float32)}
    return Net(p, first, of)


@dataclass
class Lexicon:
    """What a token is to the network: its output number, and its count if it is in the table."""
    tokens: np.ndarray   # sorted hashes of the table
    counts: np.ndarray
    output: np.ndarray   # -1: by bucket
    buckets: np.ndarray  # output of each bucket
    end: int             # output of the end token
    starts: np.ndarray | None = None  # made by the first task of a worker that asks

    def look_up(self, h: np.ndarray, bucket: np.ndarray):
        """(output, count or -1) of every token."""
        if not len(self.tokens):
            return self.buckets[bucket], np.full(len(h), -1)
        # the top bits of a hash say where its few neighbours begin
        if self.starts is None:
            self.shift = np.uint64(max(40, 63 - len(self.tokens).bit_length()))
            cells = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
            self.starts = np.searchsorted(self.tokens, cells).astype(np.int32)
            self.longest = int(np.diff(self.starts, append=len(self.tokens)).max())
            self.upto = np.append(self.tokens, ~np.uint64(0))
        at = self.starts[h >> self.shift]
        for _ in range(self.longest):
            at += self.upto[at] < h
        np.minimum(at, len(self.tokens) - 1, out=at)
        hit = self.tokens[at] == h
        out = np.where(hit, self.output[at], -1)
        return np.where(out >= 0, out, self.buckets[bucket]).astype(np.int32), np.where(hit, self.counts[at], -1)


def forward(net: Net, ids: np.ndarray, state: np.ndarray, keep: bool = False):
    """States of the gated unit, (time + 1, batch, HIDDEN): before the first of the (time, batch)
    inputs and after each; with ``keep`` also the gates and the candidate of each step,
    (time, 3, batch, HIDDEN)."""
    p, h = net.p, HIDDEN
    x = (p["E"] @ p["W"].T + p["b"]).reshape(-1, 3, h)
    outer = np.ascontiguousarray(-x[:, :2].transpose(1, 0, 2))  # both gates by themselves, so that rows lie together
    outer, update = np.stack([outer[0][ids], outer[1][ids]], axis=1), np.ascontiguousarray(x[:, 2])[ids]
    gate = np.ascontiguousarray(-p["U"][:2 * h].reshape(2, h, h).transpose(0, 2, 1))
    inner = np.ascontiguousarray(p["U"][2 * h:].T)
    states = np.empty((len(ids) + 1, *state.shape), state.dtype)
    states[0] = state
    gates = np.empty((len(ids) if keep else 1, 3, *state.shape), state.dtype)
    for t in range(len(ids)):
        before, after, here = states[t], states[t + 1], gates[t if keep else 0]
        zr, c = here[:2], here[2]
        np.matmul(before, gate, out=zr)
        zr += outer[t]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(here[1], before, out=after)
        np.matmul(after, inner, out=c)
        c += update[t]
        np.tanh(c, out=c)
        np.subtract(before, c, out=after)
        after *= here[0]
        after += c
    return states, gates


def _shares(states, weights, bias, mine, want_rest: bool):
    """Logit of the outputs ``mine`` under one softmax and the sum of it; with it the probabilities."""
    x = states @ weights.T
    x += bias
    picked = x[np.arange(len(mine)), mine]
    np.minimum(x, 60, out=x)  # far above any trained value; keeps the sum finite
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if want_rest:
        x /= total[:, None]
    return picked, total, x


def token_logs(net: Net, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log probability of each token given the state before it.

    Tokens are sorted by class, so each class is one small product over its run of rows.
    """
    p = net.p
    cls = net.of[ids]
    order = np.argsort(cls.astype(np.uint16), kind="stable")  # classes are far fewer
    states, ids, cls = states[order], ids[order], cls[order]
    inside = ids - net.first[cls]
    edges = np.searchsorted(cls, np.arange(len(net.first)))
    logs = np.empty(len(ids))
    for k in range(0, len(ids), _ROWS):
        at = slice(k, k + _ROWS)
        picked, total, _ = _shares(states[at], p["C"], p["cb"], cls[at], False)
        logs[at] = picked - np.log(total.astype(np.float64))
    own, sums = np.zeros(len(ids), states.dtype), np.ones(len(ids), states.dtype)
    for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(net.first) > 1)):
        at, some = slice(edges[k], edges[k + 1]), slice(net.first[k], net.first[k + 1])
        own[at], sums[at], _ = _shares(states[at], p["O"][some], p["ob"][some], inside[at], False)
    logs += own - np.log(sums.astype(np.float64))
    out = np.empty_like(logs)
    out[order] = logs
    return out


def token_gradients(net: Net, states: np.ndarray, ids: np.ndarray, grads: dict):
    """``token_logs`` of the few tokens of a training step, and the gradient of their summed negative.

    It is added to ``grads`` and returned for the states. The runs of the classes are cut into tiles of
    ``_TILE`` rows, filled up with nothing, and all tiles are one product: at most a tile a class is
    not full.
    """
    p, wide = net.p, int(np.diff(net.first).max())
    cls = net.of[ids]
    picked, total, d = _shares(states, p["C"], p["cb"], cls, True)
    logs = picked - np.log(total.astype(np.float64))
    d[np.arange(len(ids)), cls] -= 1
    grads["C"] += d.T @ states
    grads["cb"] += np.ones(len(d), d.dtype) @ d
    back = d @ p["C"]
    width = np.diff(net.first)
    use = np.flatnonzero(width[cls] > 1)  # a class of one output has nothing to choose
    if not len(use):
        return logs, back
    order = use[np.argsort(cls[use].astype(np.uint16), kind="stable")]  # classes are far fewer
    cls, ids = cls[order], ids[order]
    have, start, count = np.unique(cls, return_index=True, return_counts=True)
    tiles = -(-count // _TILE)
    base = np.cumsum(tiles) - tiles
    place = np.arange(len(cls)) + np.repeat(base * _TILE - start, count)
    s = np.zeros((tiles.sum() * _TILE, states.shape[1]), states.dtype)
    s[place] = states[order]
    s3 = s.reshape(-1, _TILE, states.shape[1])
    real = np.arange(wide) < width[have][:, None]
    rows = np.where(real, net.first[have][:, None] + np.arange(wide), 0)
    of = np.repeat(np.arange(len(have)), tiles)
    o = p["O"][rows][of]
    x = s3 @ o.transpose(0, 2, 1)
    x += np.where(real, p["ob"][rows], np.float32(-1e30))[of][:, None, :]
    flat = x.reshape(-1, wide)
    mine = ids - net.first[cls]
    own = flat[place, mine]
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    sums = flat @ np.ones(wide, x.dtype)
    logs[order] += own - np.log(sums[place].astype(np.float64))
    share = np.zeros(len(flat), x.dtype)
    share[place] = 1 / sums[place]
    flat *= share[:, None]
    flat[place, mine] -= 1
    ends = np.append(base, len(x)) * _TILE
    for k, low, high in zip(have, ends[:-1], ends[1:]):  # the rows of a class lie together
        grads["O"][net.first[k]:net.first[k + 1]] += (flat[low:high].T @ s[low:high])[:width[k]]
    grads["ob"][rows[real]] += np.add.reduceat(flat, ends[:-1])[real]
    back[order] += (x @ o).reshape(-1, states.shape[1])[place]
    return logs, back


def gradients(net: Net, ids: np.ndarray, state: np.ndarray, out: dict | None = None) -> tuple[dict, float]:
    """Gradient of the mean loss of one (time, batch) window; the first token is the context.

    Numbers below 0 fill up windows that are shorter: nothing is learned from them. ``out`` names
    arrays of zeros that take the gradients.
    """
    p, h = net.p, HIDDEN
    g = out or {k: np.zeros_like(v) for k, v in p.items()}
    inputs, targets = np.maximum(ids[:-1], 0), ids[1:]
    steps, batch = inputs.shape
    states, gates = forward(net, inputs, state, keep=True)
    after = states[1:].reshape(steps * batch, h)
    use = np.flatnonzero(targets.ravel() >= 0)
    logs, some = token_gradients(net, after[use], targets.ravel()[use], g)
    back = np.zeros_like(after)
    back[use] = some
    back = back.reshape(steps, batch, h)
    before = states[:-1]
    z, r, c = gates[:, 0], gates[:, 1], gates[:, 2]
    # what a gate passes on of the gradient of its state, for all steps at once
    to_c = (1 - z) * (1 - c * c)
    to_z = (before - c) * z * (1 - z)
    to_r = before * r * (1 - r)
    outer, inner = p["U"][:2 * h].reshape(2, h, h), np.ascontiguousarray(p["U"][2 * h:])
    d = np.zeros((batch, h), after.dtype)
    dx = np.empty((3, steps, batch, h), after.dtype)
    for t in range(steps - 1, -1, -1):
        d += back[t]
        dz, dr, dc = dx[0, t], dx[1, t], dx[2, t]
        np.multiply(d, to_c[t], out=dc)
        np.multiply(d, to_z[t], out=dz)
        drs = dc @ inner
        np.multiply(drs, to_r[t], out=dr)
        d *= z[t]
        drs *= r[t]
        d += drs
        d += dz @ outer[0]
        d += dr @ outer[1]
    old = before.reshape(-1, h)
    parts = [x.reshape(-1, h) for x in dx]
    for k, left in enumerate((old, old, (r * before).reshape(-1, h))):
        g["U"][k * h:(k + 1) * h] += parts[k].T @ left
    flat = np.concatenate(parts, axis=1)
    g["W"] += flat.T @ p["E"][inputs.ravel()]
    g["b"] += np.ones(len(flat), flat.dtype) @ flat
    cell = inputs.reshape(-1, 1) * EMBED + np.arange(EMBED)
    g["E"] += np.bincount(cell.ravel(), (flat @ p["W"]).ravel(), g["E"].size).reshape(g["E"].shape).astype(g["E"].dtype)
    n = max(1, len(use))
    for v in g.values():
        v /= n
    return g, -logs.sum() / n


def windows_of(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """(windows, WINDOW + 1) token numbers: of every text each run of WINDOW tokens behind the token
    before it (``start`` at the beginning); the last one of a text is filled up with -1."""
    count = -(-sizes // WINDOW)
    first = np.repeat(np.cumsum(sizes) - sizes, count)  # of the text
    at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    place = at[:, None] + np.arange(-1, WINDOW)
    out = ids[np.clip(first[:, None] + place, 0, max(0, len(ids) - 1))]
    out[place < 0] = start
    out[place >= np.repeat(sizes, count)[:, None]] = -1
    return out


def _views(flat: np.ndarray, like: dict) -> dict:
    """Arrays of the shapes of ``like`` that lie one after another in ``flat``."""
    at = np.cumsum([0, *(v.size for v in like.values())])
    return {k: flat[i:i + v.size].reshape(v.shape) for (k, v), i in zip(like.items(), at)}


def train(net: Net, windows: np.ndarray) -> Net:
    """One pass of Adam over (windows, WINDOW + 1) token numbers, in batches."""
    flat = np.concatenate([v.ravel() for v in net.p.values()])  # all parameters move at once
    net = Net(_views(flat, net.p), net.first, net.of)
    m, v2, g = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    into = _views(g, net.p)
    for step, k in enumerate(range(0, len(windows), BATCH), 1):
        some = windows[k:k + BATCH].T
        g[:] = 0
        gradients(net, some, np.zeros((some.shape[1], HIDDEN), np.float32), into)
        m += 0.1 * (g - m)
        g *= g
        g -= v2
        g *= 0.01
        v2 += g
        root = np.sqrt(v2 / (1 - 0.99 ** step))
        root += 1e-7
        flat -= RATE / (1 - 0.9 ** step) * m / root
    return net


def train_round(docs: DataFrame, net: Net, lexicon: Lexicon) -> Net:
    """Average of copies of the network, each trained on the windows of one task's documents."""
    names = sorted(net.p)
    sent = docs.sparkSession.sparkContext.broadcast((net, lexicon))  # bounded by VOCABULARY and TABLE

    def run(batches):
        net, lexicon = sent.value
        windows, held, used = [], 0, 0
        for b in batches:
            h, bucket, sizes = tokenise(b["text"].to_pylist())
            ids, _ = lexicon.look_up(h, bucket)
            windows.append(windows_of(ids, sizes, lexicon.end))
            held += len(windows[-1])
            if held >= 40 * BATCH:
                used += held
                net = train(net, np.concatenate(windows))
                windows, held = [], 0
        if held:
            used += held
            net = train(net, np.concatenate(windows))
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([used] * len(names), pa.int64()),
                 pa.array([net.p[k].ravel().tobytes() for k in names], pa.binary())], ["name", "n", "data"])

    def average(key, table):
        total, n = 0.0, 0
        for w, data in zip(table["n"].to_pylist(), table["data"].to_pylist()):
            total, n = total + w * np.frombuffer(data, np.float32).astype(np.float64), n + w
        return pa.table({"name": [key[0].as_py()], "n": [n], "data": [(total / n).astype(np.float32).tobytes()]})

    kind = "name string, n long, data binary"
    # two levels: parts of the copies are averaged in up to 16 tasks, then those averages
    copies = docs.select("text").mapInArrow(run, kind).withColumn("part", F.spark_partition_id() % 16)
    some = copies.groupBy("name", "part").applyInArrow(average, kind)
    rows = some.groupBy("name").applyInArrow(average, kind).collect()  # one network
    if not rows:
        return net
    return Net({r["name"]: np.frombuffer(r["data"], np.float32).reshape(net.p[r["name"]].shape).copy() for r in rows},
               net.first, net.of)


_LANES = 384


def score_texts(net: Net, ids: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log probability of each whole sequence of outputs, ``start`` before it as context."""
    out = np.zeros(len(ids))
    order = sorted(range(len(ids)), key=lambda k: len(ids[k]))
    for k in range(0, len(order), _LANES):
        lane = order[k:k + _LANES]
        length = np.array([len(ids[i]) for i in lane])
        state = np.zeros((len(lane), HIDDEN), np.float32)
        at = 0
        while at < length.max():
            live = np.flatnonzero(length > at)
            steps = int(min(WINDOW * 4, length.max() - at, max(WINDOW, length[live].min() - at)))
            inputs = np.zeros((steps, len(live)), np.int32)
            targets = np.full((steps, len(live)), -1, np.int64)
            for j, i in enumerate(live):
                seq = ids[lane[i]]
                piece = seq[at:at + steps]
                before = seq[at - 1:at] if at else [start]
                targets[:len(piece), j] = piece
                inputs[:len(piece), j] = np.concatenate((before, piece[:-1]))
            states, _ = forward(net, inputs, state[live])
            use = targets.ravel() >= 0
            logs = token_logs(net, states[1:].reshape(-1, HIDDEN)[use], targets.ravel()[use])
            who = np.broadcast_to(live, targets.shape).ravel()[use]
            out[[lane[i] for i in live]] += np.bincount(who, logs, len(lane))[live]
            state[live] = states[len(inputs)]
            at += steps
    return out


def _lexicon(counts: DataFrame) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """The lexicon, the mass of every output, and the mass of every bucket's own tokens."""
    end = counts.where(F.col("token") == int(END.view(np.int64))).agg(F.max("c")).first()[0] or 0
    words = counts.where(F.col("token") != int(END.view(np.int64)))
    # at most TABLE rows
    top = words.orderBy(F.desc("c"), "token").limit(TABLE).toArrow()
    token = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    c, bucket = top["c"].to_numpy(), top["bucket"].to_numpy()
    n = min(VOCABULARY, len(c))
    mass = np.full(BUCKETS, 0.1)  # one unseen token each
    for r in words.groupBy("bucket").agg(F.sum(F.col("c") + 0.1).alias("m")).collect():
        mass[r["bucket"]] += r["m"]
    np.subtract.at(mass, bucket[:n], c[:n] + 0.1)
    mass = np.maximum(mass, 0.1)
    # outputs in order of mass, so that classes hold outputs of like frequency
    every = np.concatenate((c[:n] + 0.1, mass, [end + 0.1]))
    order = np.argsort(-every, kind="stable")
    number = np.empty(len(every), np.int32)
    number[order] = np.arange(len(every))
    output = np.full(len(c), -1, np.int32)
    output[:n] = number[:n]
    token, c, output = np.append(token, END), np.append(c, end), np.append(output, number[-1])
    by = np.argsort(token)
    return (Lexicon(token[by], c[by], output[by], number[n:n + BUCKETS], int(number[-1])), every[order], mass)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    Null and empty texts hold the end token only. Repeated rows are scored each. Without
    training documents every token is unseen: both scores are those of the empty model.
    """
    spark = docs.sparkSession
    rows = row_key(docs.select("doc_id", "text")).withColumn("held_out", remainder("doc_id", 10) == 0)
    training = rows.where(~F.col("held_out"))
    counts = materialise(token_counts(training), "counts")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    log_mass = float(np.log10(total + 0.1 * (distinct + 1)))
    lexicon, masses, bucket_mass = _lexicon(counts)
    net = new_net(masses)
    for k in range(ROUNDS if total else 0):
        net = train_round(training.where(F.pmod("_k1", F.lit(ROUNDS)) == k), net, lexicon)
    sent = spark.sparkContext.broadcast((net, lexicon, np.log10(bucket_mass)))  # bounded as above
    schema = ("doc_id long, held_out boolean, _k1 long, _k2 long, n_tokens long, n_known long, base double, "
              "score double, rest array<struct<token: long, n: long>>")
    names = [x.split()[0] for x in schema.split(", ") if "<" not in x][:8] + ["rest"]
    kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        net, lexicon, log_bucket = sent.value
        for b in batches:
            h, bucket, sizes = tokenise(b["text"].to_pylist())
            if not len(sizes):
                continue
            out, c = lexicon.look_up(h, bucket)
            begin = np.cumsum(sizes) - sizes
            # the shares of tokens that the network has no output of their own for
            own = np.zeros(len(net.of), bool)
            own[lexicon.output[lexicon.output >= 0]] = True
            shared = ~own[out]
            log_c = np.log10(np.where(c >= 0, c, 0) + 0.1) * (c >= 0)
            base = np.add.reduceat(log_c, begin)
            parts = np.add.reduceat(np.where(shared, log_c - log_bucket[bucket], 0.0), begin)
            logs = score_texts(net, np.split(out, begin[1:]), lexicon.end) / np.log(10)
            away = np.flatnonzero(c < 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)[away]
            order = np.lexsort((h[away], doc))
            doc, tok = doc[order], h[away][order]
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tok[1:] != tok[:-1]))[:len(doc)])
            n = np.diff(np.append(new, len(doc)))
            offsets = np.searchsorted(doc[new], np.arange(len(sizes) + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(tok[new].view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), b["held_out"], b["_k1"], b["_k2"], pa.array(sizes.astype(np.int64)),
                 pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), pa.array(base), pa.array(parts + logs),
                 rest], names)

    scored = materialise(rows.select("doc_id", "held_out", "_k1", "_k2", "text").mapInArrow(run, schema), "scored")
    # counts of the other tokens by a join: (document, token) rows, no text
    asked = scored.select("_k1", "_k2", F.explode("rest").alias("r")).select("_k1", "_k2", "r.token", "r.n")
    met = asked.join(counts.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("_k1", "_k2").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("l"))
    # rows that repeat a document have each asked for all of its tokens
    copies = scored.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("copies"))
    out = scored.drop("rest").join(copies, ["_k1", "_k2"]).join(sums, ["_k1", "_k2"], "left")
    l = F.coalesce(F.col("l") / F.col("copies"), F.lit(0.0))
    k = F.coalesce(F.col("k") / F.col("copies"), F.lit(0.0)).cast("long")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + k).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + l - F.col("n_tokens") * log_mass).alias("base_score"), (F.col("score") + l).alias("score"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from those whose crc32(id) mod 10 is not 0."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long"), "text"))
