"""Registered queries that write files from the tables and read or stream them back.

The files are the stand-in input of jobs that work on files; they hold the tables' rows and lie
under the shared checkpoint folder. What is read back goes through the library's readers, streams
and recogniser calls.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from linecraft import oracle as O
from linecraft.catalog import _FONTS_SQL, _PAIRS_SQL, _PART_DICT_SQL, ORACLE, _docs, _lines, register
from linecraft.functions import text as T
from linecraft.operators import images as IM
from linecraft.operators import links as LK
from linecraft.operators import predict as PD
from linecraft.operators import render as R
from linecraft.operators.ordering import written
from linecraft.plans import render as PR
from linecraft.plans import scoring as S
from linecraft.plans.corpus import LATIN
from linecraft.session import scratch_path, spread, table
from linecraft.sources import files as FS
from linecraft.sources import textfiles as TF
from linecraft.streaming import streams as ST


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------------------------------
# Files (A1, A2, A6, A7)
# ---------------------------------------------------------------------------------------

@register("file_lines", f"""
WITH {O.lines_cte(max_chars=200)}
SELECT line_no, text FROM lines
""")
def q_file_lines(spark, sf):
    """A1 from files: lines of text files holding all documents, numbered over files and splits."""
    path = _folder(spark, "lines")
    TF.write_lines_in_order(_docs(spark, sf).select("doc_id", "text"), path, "doc_id", "text")
    return TF.read_file_lines(spark, path, 200).select("line_no", "text")


@register("read_dict", f"""
WITH {_PART_DICT_SQL}
SELECT 'en' AS lang, word_no, word FROM dict
""")
def q_read_dict(spark, sf):
    """A2 from files: a dictionary of part names written as word files and read back."""
    path = _folder(spark, "dict")
    TF.write_lines_in_order(TF.dict_from_words(table(spark, sf, "part"), "p_name"), path, "word_no", "word")
    return TF.read_dict(spark, path, "en")


@register("metadata_files", """
SELECT printf('%08d.jpg', doc_id) AS file_name, text FROM documents
""")
def q_metadata_files(spark, sf):
    """Whole documents as labels (line feeds, quotes) to metadata CSV and back by splits."""
    path = _folder(spark, "metadata")
    rows = _docs(spark, sf).select("doc_id", F.format_string("%08d.jpg", "doc_id").alias("file_name"), "text")
    TF.write_metadata(rows, path, "doc_id")
    return TF.read_metadata(spark, path)


@register("corpus_file", f"""
WITH {O.chunks_cte()},
kept AS (SELECT chunk, sentence FROM chunks WHERE NOT repeated)
SELECT CAST(row_number() OVER (ORDER BY chunk) - 1 AS BIGINT) AS line_no, sentence FROM kept
""")
def q_corpus_file(spark, sf):
    """Every chunk without a repeated pair to a corpus file, one a line, in order, and back."""
    from linecraft.plans.corpus import corpus_chunks
    path = _folder(spark, "corpus")
    TF.write_corpus(corpus_chunks(_docs(spark, sf)).where(~F.col("repeated")), path)
    return TF.read_file_lines(spark, path, None).select("line_no", F.col("text").alias("sentence"))


# ---------------------------------------------------------------------------------------
# Streams (K1-K3, J1)
# ---------------------------------------------------------------------------------------

@register("stream_samples", f"""
WITH {O.lines_cte()},
idx AS (SELECT unnest(range(3 * (SELECT count(*) FROM lines))) AS idx)
SELECT CAST(idx.idx AS BIGINT) AS idx, lines.text, f.font
FROM idx JOIN lines ON lines.line_no = idx.idx % (SELECT count(*) FROM lines)
JOIN {_FONTS_SQL} ON f.font_no = idx.idx % {len(PR.FIXTURE_FONTS)}
""")
def q_stream_samples(spark, sf):
    """K1: the endless sample stream, stopped and resumed after each of three batches of all lines."""
    job, n = ST.sample_job(_lines(spark, sf).select("line_no", "text"), PR.fonts_table(spark))
    counter = ST.sample_counter(spark, rows_per_batch=n)
    folder, checkpoint = _folder(spark, "samples"), _folder(spark, "samples-checkpoint")
    for _ in range(3):
        ST.each_batch_once(counter, folder, checkpoint, trigger={"once": True},
                           job=lambda batch: job(batch).select("idx", "text", "font")).awaitTermination()
    return ST.read_batches(spark, folder, "idx long, text string, font string").drop("batch")


@register("stream_score_by_lang", ORACLE["score_by_lang"])
def q_stream_score_by_lang(spark, sf):
    """K2: error rates by language as streaming state, stopped after half of the pairs and resumed."""
    # the chunks are cut once; either half arrives from there
    pairs = written(S.chunk_pairs(_docs(spark, sf)).select("chunk", "lang", "ref", "pred"), "pairs")
    arriving, folder, checkpoint = (_folder(spark, n) for n in ("pairs", "rates", "rates-checkpoint"))
    for half in (0, 1):
        pairs.where(F.pmod("chunk", F.lit(2)) == half).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", ST.files_per_batch(spark)) \
            .parquet(arriving)
        rates = ST.stream_error_rates(stream, by=("lang",), short=S.is_short(LATIN))
        ST.each_batch_once(rates, folder, checkpoint, "update").awaitTermination()
    return ST.latest_by(ST.read_batches(spark, folder, rates.schema), ["lang"])


def _read_pages(batches):
    """Stub recogniser: a file's text is what its bytes say."""
    model = PD.per_worker("stub-reader", lambda: (lambda content: bytes(content).decode("utf-8")))
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "text": pdf["content"].map(model)})


@register("stream_recognise", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(replace(text, chr(10), ' ')) AS md5 FROM documents
""")
def q_stream_recognise(spark, sf):
    """K3 + J1: files (16 documents each, a line per document) recognised as they arrive, half by half,
    by a stub that reads bytes as text; every document comes back once."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(" ", F.col("doc_id"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    arriving, folder, checkpoint = (_folder(spark, n) for n in ("images", "texts", "texts-checkpoint"))
    for half in (0, 1):
        (docs.where(F.pmod("doc_id", F.lit(2)) == half).select("value")
         .write.mode("append").option("maxRecordsPerFile", 16).text(arriving))
        files = ST.stream_files(spark, arriving, "*.txt", max_files_per_trigger=256)
        ST.stream_predict_once(files, _read_pages, "path string, text string", folder, checkpoint).awaitTermination()
    rows = ST.read_batches(spark, folder, "path string, text string").select(
        F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    at = F.instr("line", " ")
    text = F.expr("substring(line, instr(line, ' ') + 1)")
    return rows.where(at > 0).select(F.expr("substring(line, 1, instr(line, ' ') - 1)").cast("long").alias("doc_id"),
                                     F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("md5"))


# ---------------------------------------------------------------------------------------
# Recogniser over regions
# ---------------------------------------------------------------------------------------

def _read_crops(batches):
    """Stub recogniser: names a crop by its width, height and first pixel."""
    for pdf in batches:
        named = [f"{c['width']}x{c['height']}:{bytes(c['data'])[0]}" for c in pdf["crop"]]
        yield pd.DataFrame({"image_id": pdf["image_id"], "box_no": pdf["box_no"], "text": named})


@register("recognise_regions", """
SELECT conv_id AS image_id, string_agg(concat(10 + length(text) % 50, 'x18:', 65 + length(text) % 26), chr(10)
       ORDER BY turn) AS text
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
""")
def q_recognise_regions(spark, sf):
    """Regions of images cropped, recognised by a stub and joined per image. An image is a
    conversation: 20 rows of 64 grey pixels for each turn, in them a region."""
    conv = table(spark, sf, "conversations").where("text IS NOT NULL")
    n = F.length("text")
    pixels = F.repeat(F.expr("chr(65 + length(text) % 26)"), 64 * 20)
    rows = conv.groupBy(F.col("conv_id").alias("image_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", pixels.alias("pixels"), (n % 50 + 10).alias("w")))).alias("rs"))
    data = F.array_join(F.transform("rs", lambda r: r["pixels"]), "").cast("binary")
    image = F.struct(F.lit("").alias("origin"), (F.size("rs") * 20).alias("height"), F.lit(64).alias("width"),
                     F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))

    def region(r, i):
        x, y = r["w"].cast("double"), (i * 20).cast("double")
        return F.array(F.array(F.lit(0.0), y), F.array(x, y), F.array(x, y + 18.0), F.array(F.lit(0.0), y + 18.0))
    images = rows.select("image_id", image.alias("image"), F.transform("rs", region).alias("points"))
    return PD.recognise_regions(images, _read_crops).select("image_id", "text")


# ---------------------------------------------------------------------------------------
# Binary files, samples and metrics
# ---------------------------------------------------------------------------------------

def _text_folders(spark, sf) -> str:
    """Files of documents, a line each, in a folder per language."""
    path = _folder(spark, "folders")
    table(spark, sf, "documents").select("lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")) \
        .write.partitionBy("lang").option("maxRecordsPerFile", 64).text(path)
    return path


@register("folder_labels", """
SELECT 'lang=' || lang AS label, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang
""")
def q_folder_labels(spark, sf):
    """Files labelled by their folder (a language), their bytes summed by label."""
    files = FS.read_folder_labelled(spark, _text_folders(spark, sf))
    return files.groupBy("label").agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@register("attach_images", """
SELECT 'lang=' || lang AS text, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents
WHERE lang <> 'de' GROUP BY lang
""")
def q_attach_images(spark, sf):
    """Label rows (folder/name and the folder as label) of all languages but one, with their files' bytes."""
    root = _text_folders(spark, sf)
    names = FS.list_files(spark, root).select(
        F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file_name"),
        F.regexp_extract("path", FS.LAST_FOLDER_RE, 1).alias("text")).where("text <> 'lang=de'")
    return FS.attach_images(names, spark, root).groupBy("text").agg(
        F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@register("sample_files", """
SELECT doc_id, lang, md5(text) AS md5, CAST(length(text) AS BIGINT) AS n_boxes FROM documents
""")
def q_sample_files(spark, sf):
    """Samples (image bytes, boxes) written by language and read back; boxes are one a character."""
    path = _folder(spark, "samples")
    boxes = F.transform(T.characters("text"), lambda c, i: F.struct((i + 1).alias("box_no"), c.alias("piece")))
    # texts are put in order of their folders before they grow boxes, many times their size
    docs = FS.in_folder_order(_docs(spark, sf).select("doc_id", "lang", "text"), "lang")
    FS.write_samples(docs.select("doc_id", "lang", F.struct(F.col("text").cast("binary").alias("data")).alias("image"),
                                 boxes.alias("boxes")), path, "lang")
    return spark.read.parquet(path).select("doc_id", "lang", F.md5("image.data").alias("md5"),
                                           F.size("boxes").cast("long").alias("n_boxes"))


@register("metrics_file", _PAIRS_SQL + """
SELECT CAST(sum(char_edits) AS DOUBLE) / CAST(sum(ref_chars) AS DOUBLE) AS cer,
       CAST(sum(word_edits) AS DOUBLE) / CAST(sum(ref_words) AS DOUBLE) AS wer FROM counted
""")
def q_metrics_file(spark, sf):
    """Overall error rates written as JSON and read back."""
    path = _folder(spark, "metrics")
    FS.write_metrics(S.score_by(_docs(spark, sf), []).select("wer", "cer"), path)
    return spark.read.schema("cer double, wer double").json(path)


# ---------------------------------------------------------------------------------------
# Cleaning of texts that need it (B2-B5, G3), contrast (B15, D8), colours (F6), scoped links
# ---------------------------------------------------------------------------------------

# Fixed values of the input: what is put around a document's text.
_AROUND = ("see http://site.example/a?b=1&c=2 now: ", "نیم‌فاصله ", "۱۲۳ 456 ٧٨٩ ", "«a-b» [c]; d_e، f؟ (g) ")


@register("clean_mixed", """
WITH around(k, a) AS (VALUES (0, 'see http://site.example/a?b=1&c=2 now: '), (1, 'نیم' || chr(8204) || 'فاصله '),
    (2, '۱۲۳ 456 ٧٨٩ '), (3, '«a-b» [c]; d_e، f؟ (g) ')),
t AS (SELECT doc_id, a || text || ' ' || a AS t FROM documents JOIN around ON k = doc_id % 4)
SELECT doc_id, md5(regexp_replace(t, 'http[^ \t\r\n\x0B\f]+', '', 'g')) AS no_url,
    md5(translate(t, '!"#$%&''()*+,./:;<=>?@[]^_`{|}~' || chr(92) || '،؍؛؟»«', '')) AS no_punct,
    md5(replace(t, chr(8204), '')) AS no_zwnj,
    md5(translate(t, '0123456789۰۱۲۳۴۵۶۷۸۹', '٠١٢٣٤٥٦٧٨٩٠١٢٣٤٥٦٧٨٩')) AS digits,
    md5(regexp_replace(regexp_replace(translate(t, '0123456789۰۱۲۳۴۵۶۷۸۹', '٠١٢٣٤٥٦٧٨٩٠١٢٣٤٥٦٧٨٩'),
        '[^a-zA-Z٠١٢٣٤٥٦٧٨٩ \t\r\n\x0B\f]+', '', 'g'), 'http[^ \t\r\n\x0B\f]+', '', 'g')) AS clean FROM t
""")
def q_clean_mixed(spark, sf):
    """B2-B5 + G3 and B6 over documents with an address, a zero-width non-joiner, three digit scripts or
    punctuation around them; digests of every step alone and of all in order."""
    around = F.element_at(F.array(*[F.lit(a) for a in _AROUND]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    t = F.concat(around, F.col("text"), F.lit(" "), around)
    steps = {"no_url": T.strip_urls("t"), "no_punct": T.strip_punct("t", "-\u06d6\u06ed"), "no_zwnj": T.strip_zwnj("t"),
             "digits": T.normalise_script("t"), "clean": T.clean_text("t", "٠١٢٣٤٥٦٧٨٩", ("a-z", "A-Z"))}
    return _docs(spark, sf).select("doc_id", t.alias("t")).select("doc_id", *[F.md5(c).alias(n) for n, c in steps.items()])


_PIXELS_SQL = """
WITH px AS (SELECT l_orderkey AS image_id, CAST(l_quantity AS INTEGER) * 5 AS c0, l_partkey % 256 AS c1, l_suppkey % 256 AS c2,
    l_linenumber % 3 AS mask_b, l_linenumber % 2 AS bg FROM lineitem),
tm AS (SELECT image_id, (avg(c0) + avg(c1)) / 3 AS text_mean, (avg(c0) + avg(c1) + avg(c2)) / 3 AS fair_mean FROM px
    WHERE mask_b <> 0 GROUP BY image_id),
bm AS (SELECT image_id, (avg(c0) + avg(c1) + avg(c2)) / 3 AS bg_mean FROM px WHERE bg = 1 GROUP BY image_id)"""


@register("contrast_filter", _PIXELS_SQL + """
SELECT image_id, round(text_mean, 6) AS text_mean, round(bg_mean, 6) AS bg_mean FROM bm JOIN tm USING (image_id)
WHERE abs(text_mean - bg_mean) >= 15
""")
def q_contrast_filter(spark, sf):
    """D8 + B15: images whose text and background differ in brightness; an order's lines are its pixels."""
    px = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_quantity").cast("int") * 5).alias("c0"),
        F.pmod("l_partkey", F.lit(256)).alias("c1"), F.pmod("l_suppkey", F.lit(256)).alias("c2"),
        F.pmod("l_linenumber", F.lit(3)).alias("mask_b"), F.pmod("l_linenumber", F.lit(2)).alias("bg"))
    stats = IM.brightness_table(px, px.where("bg = 1").select("image_id", "c0", "c1", "c2"))
    return IM.contrast_filter(stats).select("image_id", F.round("text_mean", 6).alias("text_mean"),
                                            F.round("bg_mean", 6).alias("bg_mean"))


@register("drawn_colours", f"""
WITH {O.lines_cte()}
SELECT line_no, CAST({O.randint('16', '240', 42, 'stroke0', 'line_no')} AS INTEGER) AS stroke_r,
       CAST({O.randint('32', '224', 42, 'stroke1', 'line_no')} AS INTEGER) AS stroke_g,
       CAST({O.randint('48', '208', 42, 'stroke2', 'line_no')} AS INTEGER) AS stroke_b FROM lines
""")
def q_drawn_colours(spark, sf):
    """F6 + G8: the stroke colour of every line, drawn between two colours."""
    drawn = R.draw_params(R.assign_recipes(_lines(spark, sf)), stroke_fill="#102030,#F0E0D0")
    return drawn.select("line_no", *[F.col("stroke")[i].cast("int").alias(f"stroke_{c}") for i, c in enumerate("rgb")])


@register("follow_listing", """
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages),  -- a request carries no fragment
h1 AS (SELECT DISTINCT a.page_id AS start_id, i.page_id AS item_id FROM p a JOIN p b ON b.page_id IN (a.page_id + 1, a.page_id + 2)
       JOIN p i ON i.url = b.url WHERE a.page_id % 10 = 0),
h2 AS (SELECT DISTINCT i.page_id AS item_id, t.page_id AS target_id FROM p i JOIN p n ON n.page_id = i.page_id + 4
       JOIN p t ON t.url = n.url WHERE i.page_id % 10 IN (1, 2, 3))
SELECT start_id, item_id, target_id, 'https://dl.example/f/' || target_id || '.ttf' AS download_url,
       target_id || '.ttf' AS file_name FROM h1 JOIN h2 USING (item_id)
""")
def q_follow_listing(spark, sf):
    """C5 + B18: links inside the first ul.list-group of a listing, then btn-success links, then the download.

    Pages carry, behind their own html, links to other rows of the table: every tenth lists the next
    two (one in a nested list) and names the third outside the list; these link to the fourth page
    after them, with the class and without; every page offers a download."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    for k in (1, 2, 3, 4, 5):
        ahead = pages.select((F.col("page_id") - k).alias("page_id"), F.col("url").alias(f"u{k}"))
        pages = pages.join(ahead, "page_id", "left")
    u = lambda k: F.coalesce(f"u{k}", F.lit("https://none.example/"))
    q = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    kind = F.pmod("page_id", F.lit(10))
    listing = F.concat(F.lit('<ul class="menu"><li><a href="'), q(u(3)), F.lit('">no</a></ul><UL class="x list-group"><li><a href="'), q(u(1)),
                       F.lit('">one</a><ul><li><a href="'), q(u(2)), F.lit('">two</a></li></ul></li></UL><ul class="list-group"><a href="'),
                       q(u(3)), F.lit('">three</a></ul>'))
    item = F.concat(F.lit('<a class="btn btn-success" href="'), q(u(4)), F.lit('">get</a><a class="btn" href="'), q(u(5)), F.lit('">no</a>'))
    download = F.concat(F.lit('<a href="https://dl.example/f/'), F.col("page_id").cast("string"), F.lit('.ttf">dl</a>'),
                        F.lit('<a href="https://dl.example/f/other.ttf">dl2</a>'))
    more = F.when(kind == 0, listing).when(kind.isin(1, 2, 3), item).otherwise(F.lit(""))
    pages = written(pages.select("page_id", "url", F.concat("html", more, download).alias("html")), "pages")
    start = pages.where(F.pmod("page_id", F.lit(10)) == 0)
    return LK.follow_links(spread(pages), start, download_prefix="https://dl.example/", container=("ul", "list-group"))
