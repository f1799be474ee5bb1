"""Error rates against a brute-force Levenshtein."""

import pytest

from linecraft.functions.edits import char_edits, word_edits
from linecraft.operators import metrics as M


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


PAIRS = [("hello world", "hello world"), ("", "abc"), ("abc", ""), ("café au lait", "cafe au lait"),
         ("the the the cat", "the cat the"), ("a b c d", "a c d x"), ("ﬁn ß", "fin ss")]


def test_pairwise_edits(spark):
    df = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(PAIRS)], "id int, ref string, pred string")
    got = df.orderBy("id").select(char_edits("ref", "pred").alias("c"), word_edits("ref", "pred").alias("w")).collect()
    for (r, p), g in zip(PAIRS, got):
        assert g.c == lev(r, p)
        assert g.w == lev(r.split(), p.split())


def test_corpus_level_rates(spark):
    df = spark.createDataFrame([(i % 2, r, p) for i, (r, p) in enumerate(PAIRS)], "epoch int, ref string, pred string")
    got = {r.epoch: r for r in M.error_rates(df, ["epoch"]).collect()}
    for e in (0, 1):
        sub = [(r, p) for i, (r, p) in enumerate(PAIRS) if i % 2 == e]
        ce = sum(lev(r, p) for r, p in sub)
        rc = sum(len(r) for r, _ in sub)
        we = sum(lev(r.split(), p.split()) for r, p in sub)
        rw = sum(len(r.split()) for r, _ in sub)
        assert got[e].cer == pytest.approx(ce / rc)
        assert got[e].wer == pytest.approx(we / rw)
    same = spark.createDataFrame([("x y", "x y")], "ref string, pred string")
    row = M.error_rates(same).first()
    assert row.cer == 0 and row.wer == 0
    empty_ref = spark.createDataFrame([("", "abc")], "ref string, pred string")
    assert M.error_rates(empty_ref).first().cer is None


def test_long_text_word_distance(spark):
    import random
    rnd = random.Random(3)
    ref = [f"w{rnd.randint(0, 3000)}" for _ in range(3000)]
    pred = [w for i, w in enumerate(ref) if i % 3 != 2]
    df = spark.createDataFrame([(" ".join(ref), " ".join(pred))], "ref string, pred string")
    assert df.select(word_edits("ref", "pred")).first()[0] == 1000


def test_pair_checks_unmatched(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "k int, pred string")
    r = spark.createDataFrame([(1, "a")], "k int, ref string")
    with pytest.raises(ValueError):
        M.pair(p, r, "k")
    assert M.pair(p.where("k = 1"), r, "k").count() == 1
    one = p.where("k = 1")
    for preds, refs in ((one.union(one), r.union(r)), (one, r.union(r)),
                        (spark.createDataFrame([(None, "a")], "k int, pred string"), r)):
        with pytest.raises(ValueError):
            M.pair(preds, refs, "k")


def test_losses_regions_and_epoch_table(spark):
    losses = spark.createDataFrame([(0, 1.0, 2), (0, 3.0, 2), (1, 2.0, 1)], "epoch int, loss double, bs int")
    ev = {r.epoch: r.eval_loss for r in M.mean_eval_loss(losses, batch_size="bs").collect()}
    assert ev == {0: 2.0, 1: 2.0}
    tr = {r.epoch: (r.train_loss, r.steps) for r in M.mean_train_loss(losses).collect()}
    assert tr == {0: (2.0, 2), 1: (2.0, 1)}
    reg = spark.createDataFrame([(1, 2, "b"), (1, 0, "a"), (2, 5, "z")], "image_id int, box_no int, text string")
    got = {r.image_id: r.text for r in M.join_regions(reg).collect()}
    assert got == {1: "a\nb", 2: "z"}
    pairs = spark.createDataFrame([(0, "a b", "a c"), (1, "x", "x")], "epoch int, ref string, pred string")
    table = {r.epoch: r for r in M.epoch_metrics(pairs, losses, losses).collect()}
    assert table[1].wer == 0.0 and table[0].wer == 0.5 and table[0].steps == 2


def test_join_regions_many_boxes_in_order(spark):
    rows = [(1, b, f"t{b}") for b in range(3000)] + [(2, 5, "only")]
    df = spark.createDataFrame(rows, "image_id int, box_no int, text string").repartition(7)
    got = {r.image_id: (r.text, r.n_regions) for r in M.join_regions(df).collect()}
    assert got[1] == ("\n".join(f"t{b}" for b in range(3000)), 3000)
    assert got[2] == ("only", 1)


def test_epoch_table_of_known_words_stays_in_the_jvm(spark):
    losses = spark.createDataFrame([(0, 1.0), (1, 2.0)], "epoch int, loss double")
    pairs = spark.createDataFrame([(0, "a b c", "a c", ["a", "b", "c"], ["a", "c"]), (1, "x", "y", ["x"], ["y"])],
                                  "epoch int, ref string, pred string, ref_words array<string>, pred_words array<string>")
    table = M.epoch_metrics(pairs, losses, losses, ref_words="ref_words", pred_words="pred_words", short=True)
    assert "ArrowEvalPython" not in table._jdf.queryExecution().toString()
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, M.epoch_metrics(pairs, losses, losses).collect()))
