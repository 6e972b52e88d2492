"""Long texts, several vector lengths, ties and clashing columns."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fieldtally.llm import chat, near_vectors, personal, warc


def test_every_vector_length_is_compared(spark):
    draw = np.random.default_rng(5)
    rows = []
    for dim, n in ((3, 60), (8, 80), (2, 12), (1, 3)):
        base = draw.normal(size=(n, dim))
        base[n // 2 :] = base[: n - n // 2] * draw.uniform(0.5, 2, (n - n // 2, 1)) + draw.normal(size=(n - n // 2, dim)) * 0.05
        rows += [(len(rows) + i, [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    links = {i: set() for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i != j and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i].add(j)
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        assert got[i] == (len(links[i]), min(seen), min(seen) == i)
    assert sum(n for n, _, _ in got.values()) > 100


def test_texts_with_many_numbers_take_time_in_proportion(spark):
    def took(n):
        text = " ".join(f"10.{i % 250}.{i // 250 % 250}.7 (784) 555-{1000 + i % 9000}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        found = df.select(*[v.alias(k) for k, v in personal.proposals(F.col("text")).items()])
        ips = found.select(F.size("ip"), F.expr("ip[1].start"), F.expr("element_at(ip, -1).end")).first()
        assert ips[0] == n and text[ips[1] :].startswith("10.1.0.7 ")
        return time.time() - start

    took(100)
    assert took(50_000) < 60


def test_many_spans_are_chosen_and_redacted(spark):
    n = 20_000
    spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("ip").alias("kind"), (i * 5).alias("start"), (i * 5 + 3).alias("end"), F.lit(0.9).alias("score")))
    df = spark.range(1).select(spans.alias("s"), F.repeat(F.lit("abc, "), n).alias("t"))
    out = df.select(F.size(personal.best(F.col("s"))).alias("n"), personal.redacted(F.col("t"), F.col("s")).alias("t")).first()
    assert out.n == n and out.t == "[IP], " * n


def test_pages_of_tags_that_never_close(spark):
    pages = [(1, "<script>" * 50_000 + "end"), (2, "a<script>x</script>b" + "<style>" * 50_000), (3, "<!-- " * 50_000 + "text --> shown"), (4, None), (5, "")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("mine")).withColumn("block", F.lit("mine"))
    start = time.time()
    out = {(r.page_id, r.record_type): r.block for r in warc.derivatives(warc.responses(df)).collect()}
    assert time.time() - start < 60 and len(out) == 10
    assert (out[1, "conversion"], out[2, "conversion"], out[3, "conversion"], out[4, "conversion"]) == ("end", "a b", "shown", "")
    twice = df.where("page_id = 2").union(df.where("page_id = 2"))
    assert warc.derivatives(warc.responses(twice)).count() == 4 and warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_turns_with_one_number_go_by_role_then_text(spark):
    rows = [(1, 0, r, t) for r, t in [("a\tb", "x"), ("a", "<|"), ("a", "<a"), ("a", "\\"), ("a", "\\n"), ("a\nb", "y"), ("a\\nb", "z"), ("a", "é"), ("a", "")]]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = chat.read_back(chat.format_chats(df)).first()
    order = sorted(((r, t) for _, _, r, t in rows), key=lambda p: (p[0].encode(), p[1].encode()))
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()


def test_pipeline_keeps_columns_named_like_results(spark, tmp_path):
    texts = ["The quick brown fox jumps over the lazy dog and runs to the river with the other animals of the forest.", "Write to joe@mail.example.org about the meeting that was planned for next week in the town hall."]
    rows = [(i, texts[i % 2] + f" Number {i // 2 * 7919} of many.", "en", "s", 100, "mine", 7, "own", "row", "place") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, copy int, base string, row_key string, place string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.select("score", "copy", "base", "row_key", "place").distinct().collect() == [("mine", 7, "own", "row", "place")], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
