"""Each operator against a brute-force version, with nulls, empty and long texts, repeats and clashing names."""

import base64
import glob
import gzip
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from fieldtally.llm import chat, common, language, mixing, near_text, near_vectors, packed, personal, repetition, tokens, warc
from fieldtally.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
TEXTS = [
    "The quick brown fox jumps over the lazy dog, again and again and again.\n" * 3,
    "The quick brown fox jumps over the lazy dog, again and again and again.\n" * 3,
    None, "", " \n\t ", "one", "é日本 😀 <|endoftext|> it's  two  spaces\r\n\nx!é,", "word " * 30, "a" * 5000,
    " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(200)) + " end", " ".join(f"W{i}" for i in range(3, 200)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, n_tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "x", "y", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, TEXTS[0], None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, id="doc_id"):
    return {r[id]: r for r in df.collect()}


# ---- tokens ---------------------------------------------------------------------------


def tiktoken_ids(text):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_byte_bpe_as_tiktoken(docs, empty):
    path = P.path("byte_bpe_50k.json")
    found = by_id(tokens.round_trip(docs, path))
    for i, t in enumerate(TEXTS):
        ids = tiktoken_ids(t or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert tokens.round_trip(empty, path).count() == 0


def test_encode_offsets_and_decode(docs):
    path = P.path("byte_bpe_50k.json")
    made = tokens.encode(docs, path, keep=["doc_id", "text"])
    for r in tokens.decode(made, path).collect():
        text = r["text"] or ""
        assert bytes(r["decoded"]).decode() == text
        assert list(r["ids"]) == tiktoken_ids(text)
        spans = list(zip(r["starts"], r["ends"]))
        assert all(0 <= a < b <= len(text) for a, b in spans)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(len(text)))


def test_packed_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path, folder = P.path("word_bpe_49k.json"), scratch_path(spark, "packed-test")
    index = packed.write_packed(docs, folder, path, length=16)
    rows = [r for r in packed.read_packed(index, folder).collect() if r["doc_id"] is not None]
    library, start = Tokenizer.from_file(path), len(Tokenizer.from_file(path).encode(TEXTS[0], add_special_tokens=False).ids) + 1
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    reader = packed.ShardReader(folder, int(index.agg(F.min("shard")).first()[0]))
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 16
    nothing = scratch_path(spark, "packed-empty")
    assert packed.read_packed(packed.write_packed(empty, nothing, path), nothing).count() == 0


# ---- quality --------------------------------------------------------------------------


def repetition_brute(text):
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_repetition(docs, empty):
    found = by_id(repetition.repetition(docs))
    for i, t in enumerate(TEXTS):
        want = repetition_brute(t or "")
        assert [found[i][c] for c in repetition.COUNTS] == want
        assert found[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (found[i]["kept"] and found[i]["base_failed"])
    assert found[9]["kept"] and found[9]["share_5"] == 0 and found[7]["share_10"] == 1
    assert repetition.repetition(empty).count() == 0


# ---- near duplicates ------------------------------------------------------------------


def linked(n, edges):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def test_near_texts_against_brute_force(spark, empty):
    rng, texts = np.random.default_rng(5), list(TEXTS)
    shared = [f"common{i}" for i in range(60)]
    for _ in range(40):  # a crowd that shares a passage without being linked
        texts.append(" ".join(shared + [f"r{rng.integers(1 << 30)}" for _ in range(25)]))
    base = [f"b{i}" for i in range(150)]
    for _ in range(50):  # copies about as near as the threshold
        own = list(base)
        for k in rng.integers(0, 150, rng.integers(1, 7)):
            own[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "c")], "doc_id long, text string, component_id string")
    sets = [shingles(t) for t in texts]
    for percent in (80, 85):
        found = by_id(near_text.near_duplicates(df.repartition(4), percent=percent))
        edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        want = linked(len(sets), edges)
        assert {i: found[i]["component_id"] for i in range(len(sets))} == dict(enumerate(want))
        assert all(found[i]["n_shingles"] == len(s) and found[i]["kept"] == (want[i] == i) for i, s in enumerate(sets))
        assert found[None]["component_id"] is None and found[None]["kept"]
    assert near_text.near_duplicates(empty).count() == 0


def test_crowded_bucket_is_compared_whole():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, 6, dtype=np.uint64)])) for _ in range(60)]
    tile, edges = near_text.Tile(0, 80), []
    for i, s in enumerate(sets):
        tile.add(i, i, s)
    for i, s in enumerate(sets):
        edges += tile.compare(i, i, s)
    want = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert linked(60, edges) == linked(60, want) and len(edges) < 60


def test_densified_signatures_have_no_gaps():
    signature = near_text.signatures([np.array([5 << 50], np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2))])
    assert (signature[0] == 5 << 50).all() and len(np.unique(signature[1])) <= 50 and (signature[1] > 0).all()


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.35
    x[200:230] = x[200]
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0] * 3), (404, [None] * 16), (405, [float("inf")] + [1.0] * 15), (406, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + [(i, v, "c") for i, v in odd], "vec_id long, embedding array<double>, n_links string")
    found = by_id(near_vectors.near_vectors(df.repartition(3)), "vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = linked(400, zip(*np.nonzero(near)))
    assert [found[i]["n_links"] for i in range(400)] == (near.sum(axis=1) - 1).tolist()
    assert [found[i]["component_id"] for i in range(400)] == want
    for i, _ in odd:
        assert found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"]
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (7, 7)]
    found = by_id(common.components(spark.createDataFrame(edges, "a long, b long")), "id")
    assert all(found[i]["component"] == 0 for i in range(41)) and found[100]["component"] == found[60]["component"] == 50


# ---- personal data --------------------------------------------------------------------

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, match):
    d = re.sub("[^0-9]", "", match)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_personal_base_spans(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab.@-+ 0123456789()é😀"), rng.integers(0, 90))) for _ in range(300)]
    texts += [None, "", "x" * 6000 + " " + "1" * 6000 + ".a" * 6000, "mail é a.b@c.de, +1 (784) 555-9263; 1.2.3.4; 4111 1111 1111 1111"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(4)
    found = personal.personal(df, keep=["doc_id", "text"])
    found = found.withColumn("clean", personal.redacted(F.coalesce("text", F.lit("")), F.col("base")))
    for r in found.select("doc_id", personal.listed(F.col("base")).alias("b"), "clean").collect():
        text = texts[r["doc_id"]] or ""
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in RULES.items() for m in re.finditer(p, text) if fits(k, m.group())]
        assert r["b"] == ",".join(spans)
        if r["doc_id"] == 303:
            assert r["clean"] == "mail é [EMAIL], [PHONE]; [IP]; [CARD]"
    assert personal.personal(df.limit(0)).count() == 0


def test_personal_adds_other_forms(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text")
    probe = "call (784) 555-9263 or 784-555-9264, write bob.42 at mail5.example dot com; version 1.2.3 of 2024-12-05"
    found = personal.personal(docs.where("text like '%@%' or text like '%555%'").union(spark.createDataFrame([(-1, probe)], "doc_id long, text string")))
    spans = {probe[s["start"] : s["end"]] for s in found.where("doc_id = -1").first()["extra"]}
    assert {"(784) 555-9263", "784-555-9264", "bob.42 at mail5.example dot com"} <= spans
    assert not spans & {"1.2.3", "2024-12-05"}


def test_personal_proposes_parts_of_runs(spark):
    texts = ["room 12 (784) 555-9263", "on 2024-12-05 (784) 555-9263", "(784) 555-9263 (784) 555-9264", "784 555 9263 785 555 9264", "at 4.10[.]0[.]0[.]1-10[.]0[.]0[.]9", "é 7 4111 1111 1111 1111 22"]
    wanted = [{"(784) 555-9263"}, {"(784) 555-9263"}, {"(784) 555-9263", "(784) 555-9264"}, {"784 555 9263", "785 555 9264"}, {"10[.]0[.]0[.]1", "10[.]0[.]0[.]9"}, {"4111 1111 1111 1111"}]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = df.select("doc_id", *[v.alias(k) for k, v in personal.proposals(F.col("text")).items()])
    made = found.select("doc_id", *[F.flatten(F.transform(g, personal.parts)).alias(g) for g in personal.RUNS])
    for r in made.collect():
        text, spans = texts[r["doc_id"]], [s for g in personal.RUNS for s in r[g]]
        assert wanted[r["doc_id"]] <= {s["match"] for s in spans}
        for s in spans:
            assert (s["match"], s["before"], s["after"]) == (text[s["start"] : s["end"]], text[max(s["start"] - 24, 0) : s["start"]], text[s["end"] : s["end"] + 8])


def test_personal_only_chosen_spans_exclude(spark):
    spans = [("phone", 0, 10, 0.7), ("phone", 8, 20, 0.8), ("card", 18, 30, 0.9), ("card", 18, 30, 0.9)]
    df = spark.createDataFrame([(spans,)], "spans array<struct<kind:string,start:int,end:int,score:double>>")
    (found,) = df.select(personal.best(F.col("spans"))).first()
    assert sorted((s["start"], s["end"]) for s in found) == [(0, 10), (18, 30)]


def test_personal_finds_neighbouring_numbers(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text").where("text like '%@%' or text like '%555%'")
    probes = ["call room 12 (784) 555-9263 now", "on 2024-12-05 (784) 555-9263 now", "call (784) 555-9263 (784) 555-9264 now", "call 784-555-9263 785-555-9264 now"]
    wanted = [["(784) 555-9263"], ["(784) 555-9263"], ["(784) 555-9263", "(784) 555-9264"], ["784-555-9263", "785-555-9264"]]
    found = personal.personal(docs.union(spark.createDataFrame([(-1 - i, p) for i, p in enumerate(probes)], "doc_id long, text string")))
    for r in found.where("doc_id < 0").collect():
        text = probes[-1 - r["doc_id"]]
        assert [text[s["start"] : s["end"]] for s in r["extra"]] == wanted[-1 - r["doc_id"]]


def test_personal_sample_by_kind(spark, monkeypatch):
    monkeypatch.setattr(personal, "SAMPLE", 40)
    texts = ["write to a@b.example now"] * 500 + [f"mail user{i}@host{i}.example" for i in range(300)] + [f"host 10.0.0.{i} up" for i in range(6)] + ["call +1 (784) 555-9263"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = df.select(*[v.alias(k) for k, v in personal.proposals(F.col("text")).items()])
    rows = personal.sample(found).collect()
    assert len(rows) == len(set((r["kind"], r["match"], r["before"], r["after"]) for r in rows))
    assert Counter(r["kind"] for r in rows) == {"email": 40, "ip": 6, "phone": 1}
    assert Counter(r["kind"] for r in rows if r["kept"]) == {"email": 10, "ip": 2, "phone": 1}
    made = personal.training_rows(found)
    assert {r["kind"] for r in made.where("label and kept").collect()} == {"email", "ip", "phone"}


def test_personal_learns_from_all_spans(spark, monkeypatch):
    monkeypatch.setattr(personal, "SAMPLE", 5)
    texts = ["write to a@b.example now"] * 20 + [f"mail user{i}@host{i}.example" for i in range(300)] + [f"host 10.0.0.{i} up" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    made = personal.training_rows(df.select(*[v.alias(k) for k, v in personal.proposals(F.col("text")).items()]))
    own = made.where("label").groupBy("kind").agg(F.countDistinct("h").alias("n"), F.countDistinct(F.when(F.col("kept"), F.col("h"))).alias("kept"))
    assert {r["kind"]: (r["n"], r["kept"]) for r in own.collect()} == {"email": (301, 76), "ip": (6, 2)}


# ---- chats, mixing, WARC, language ----------------------------------------------------


def test_chat_round_trip(spark):
    said = ["", "plain", "\\### Assistant: </turn> ok", "<|end|>\n<|turn|>user\nx", "\\<|\\\\n é😀", "<", "|x", "<\\|", "\n"]
    rows = [(c, t, r, s) for c in (1, 2, None) for t, (r, s) in enumerate([(r, s) for s in said for r in ("user", "assistant", None, "a\nb\\")])]
    rows += [(3, None, "user", None), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat.format_chats(df)
    for r in formatted.collect():
        ((role, text),) = chat.parse(r["formatted"])
        assert (role == "assistant") == (r["loss_start"] is not None)
        if r["loss_start"] is not None:
            assert chat.unescaped(r["formatted"][r["loss_start"] : r["loss_end"]]) == text
    found = by_id(chat.read_back(formatted), "conv_id")
    for c in (1, 2, None):
        turns = [(r or "", s or "") for i, _, r, s in rows if i == c]
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in turns).encode()).hexdigest()
        loss = "".join(s for r, s in turns if r == "assistant")
        assert (found[c]["n_turns"], found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[3]["n_turns"] == 3 and found[3]["loss_chars"] == 6
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_mixing_meets_rates(spark, empty):
    rows = [(i, "x" * 100, "big" if i < 3000 else "small") for i in range(4000)] + [(None, None, None), (5, "x" * 100, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    found = mixing.mix(df, weights={"big": 0.25, "small": 0.75}, epochs=2.0).collect()
    count = Counter(r["source"] for r in found)
    assert abs(count["small"] / 6000 - 1) < 0.06 and abs(count["big"] / 2000 - 1) < 0.1 and None not in count
    places = [r["place"] for r in found]
    assert places == sorted(places) and max(r["copy"] for r in found) > 6
    spread = Counter(Counter(r["doc_id"] for r in found if r["source"] == "small").values())
    assert abs(spread[6] / 1000 - 0.1606) < 0.05
    assert mixing.mix(empty).count() == 0


def test_warc_files(spark):
    html = '<html lang="fr"><head><title>A &amp; b</title></head><body><p>One&nbsp;two &#233;&#x1F600; &#38;lt;</p><script>x<1</script><a title="a>b">link</a><br>3 < 4</body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    rows = {(r["page_id"], r["record_type"]): r for r in records.collect()}
    text = rows[1, "conversion"]
    assert text["block"] == "One two é😀 &lt;\nlink\n3 < 4"
    assert text["refers_to"] == rows[1, "metadata"]["refers_to"] and text["concurrent_to"] == rows[1, "metadata"]["record_id"]
    assert "language: fr" in rows[1, "metadata"]["block"] and text["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert rows[2, "conversion"]["block"] == "" and len(rows) == 6
    folder = scratch_path(spark, "warc")
    warc.write_warc(records, folder)
    seen = 0
    for name in glob.glob(folder.removeprefix("file:") + "/part-*"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            assert hashlib.sha256(rest[:n]).hexdigest().encode() in head
            data, seen = rest[n + 4 :], seen + 1
    assert seen == 6


def test_language(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language.prototypes(docs)
    found = language.identify(docs.withColumn("score", F.lit("clash")), model).where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97 and all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (4, "日本語")], "doc_id long, text string")
    got = by_id(language.identify(odd, model))
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in model[0]
    assert language.identify(odd, language.prototypes(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    bundle, has = language.Letters(64).bundles(pa.array(["abc", "abc abc", None]))
    assert has.tolist() == [True, True, False] and not bundle[2].any()
    assert json.dumps(model[0]) == '["de", "en", "es", "fr"]'


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    text, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(5, text), (3, text), (3, text), (None, text), (None, other), (None, other), (3, other), (7, ""), (7, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert Counter(found) == {(3, text): 1, (3, other): 1, (7, ""): 2, (None, None): 1}


def test_pipeline_keeps_texts_where_no_language_was_learnt(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "Plain text.", None), (2, "12 34", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, "").collect()} == {1, 4}
