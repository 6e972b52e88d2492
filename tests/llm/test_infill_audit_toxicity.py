"""Fill-in-middle, filter audit and toxicity against plain versions, with nulls, repeats, long texts and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from fieldtally.llm import infill, interaction, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, body string, form string, mask long, key string, score double, hits int"


def frame(spark, rows):
    """Rows of (doc_id, text, lang), with columns that clash with the operators' own."""
    full = [(i, t, lang, "s", len(t or ""), 5, "b", "f", 9, "k", 0.5, 1) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)


# ---- fill-in-middle -------------------------------------------------------------------


def plain_infill(id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


LINES = [
    None, "", "\n", "\n\n\n", "one", "é日本 😀\nzwei\n\ndrei", "a <P> b\nc", "<M>", "<\nP>\n<S\n", "x\r\ny z\n", "line\n" * 5000,
    "L" * 100_000, "é" * 40_000 + "\n" + "日" * 30_000, "".join(f"{i} " + "w" * (i % 400) + "\n" for i in range(600)),
]


def test_infill_as_plain(spark):
    rows = [(i * 100 + k, t, "en") for k in range(4) for i, t in enumerate(LINES)] + [(None, LINES[5], "en"), (7, LINES[13], None), (7, LINES[13], None)]
    expected = Counter()
    for i, t, _ in rows:
        n, form, p, m, out = plain_infill(i, t)
        expected[(i, n, form, p, m, out, t or "", hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    found = infill.fill_in_middle(frame(spark, rows))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256"]
    assert Counter(tuple(r) for r in found.select(*names).collect()) == expected
    assert {"plain", "psm", "spm"} == {e[2] for e in expected}
    assert infill.fill_in_middle(frame(spark, [])).count() == 0


def test_infill_rates(spark):
    rows = [(i, f"a{i}\nb\nc\n", "en") for i in range(200)]
    forms = Counter(r["form"] for r in infill.fill_in_middle(frame(spark, rows), rate=50, spm=0).collect())
    assert forms["spm"] == 0 and 60 < forms["plain"] < 140 and forms["psm"] + forms["plain"] == 200


def test_pieces_are_bounded_runs_of_units(spark):
    made = infill.pieces(frame(spark, [(1, LINES[13], "en"), (2, LINES[11], "en")])).collect()
    assert max(len(r["body"]) for r in made) <= infill.CHUNK + 3 and len(made) > 12
    one = sorted((r["at"], bytes(r["body"])) for r in made if r["row"] == next(q["row"] for q in made if q["doc_id"] == "1"))
    assert all(b.endswith(b"\n") for _, b in one if len(b) > 3)


# ---- filter audit ---------------------------------------------------------------------


def plain_audit(docs, labels):
    smaller = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            smaller[t or ""].append(i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(smaller[t]) < i,
        }
        fails.append((lang or "", {f for f, bad in own.items() if bad}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                own = [(bad, g, x) for p, bad, g, x in fails if p == part]
                gone = [bool(bad & set(order[: step - 1])) for bad, _, _ in own]
                removed = [o for o, was in zip(own, gone) if f in o[0] and not was]
                redundant = sum(f in o[0] and was for o, was in zip(own, gone))
                kept = sum(not o[0] & set(order[:step]) for o in own)
                shapley[part, f] += len(removed)
                out[part, order, step] = (kept, len(removed), redundant, sum(o[0] == {f} for o in own), sum(o[1] for o in removed), sum(o[2] for o in removed))
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_as_plain(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "A B C", " \t\n", "x | y", "same same"] + [
        " ".join(draw.choice(words[:most]) for _ in range(draw.choice([150, 250]))) + draw.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRST"]) for most in (60, 400) for _ in range(20)
    ]
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", None, "", "fr"])) for i in range(300)] + [(None, texts[7], "en")] * 3 + [(5, texts[8], "en")] * 2 + [(4, texts[8], "en")] * 2
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = interaction.audit(interaction.document_cells(frame(spark, docs), held)).collect()
    assert Counter(tuple(r) for r in found) == plain_audit(docs, labels)
    assert interaction.audit(interaction.document_cells(frame(spark, []), held)).count() == 0


def test_gray_walk_as_subsets():
    cells = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    states = interaction.gray_states(cells, 5)
    for subset in range(32):
        alive = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == cells[:, alive].sum(axis=1)).all()


# ---- toxicity -------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_as_edit_distance():
    draw = random.Random(3)
    terms = ["idiot", "loser", "moron", "worthless", "disgusting", "bad", "abba", "abbaabbaab"]
    words = ["".join(draw.choice("abdilmorstw") for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    for t in terms * 40:  # near ones
        w = list(t)
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.randint(0, 1)] = draw.choice(["", "x", "a", "o"])
        words.append("".join(w) or "q")
    automaton = toxicity.Automaton([(t, 0, 1.0) for t in terms])
    slice_ = toxicity.Words(pa.array(words))
    assert len(slice_.starts) == len(words)
    hits = toxicity.find_hits(slice_, automaton)
    found = {int(t): int(e) for t, e in zip(hits.text, hits.edits)}
    for i, w in enumerate(words):
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.allowed(t)]
        assert found.get(i) == (min(near) if near else None), w


def labelled(spark, n=600, seed=2):
    """Texts of neutral words; toxic ones hold insults, a fifth of them misspelt."""
    draw = random.Random(seed)
    insults = ["idiot", "loser", "worthless", "disgusting", "scum"]
    neutral = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("na", "vu", "ke") for c in ("sh", "rn", "pt", "lo")]
    rows = []
    for i in range(n):
        words = [draw.choice(neutral) for _ in range(draw.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(draw.randint(2, 4) if toxic else 0):
            w = draw.choice(insults)
            if draw.random() < 0.2:
                k = draw.randrange(len(w))
                w = w[:k] + "x" + w[k + 1 :]
            words.insert(draw.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled(spark)
    docs = frame(spark, [(i, t, "en") for i, t, _ in rows] + [(None, "idiot idiot", "en")])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    return toxicity.learn(docs, labels), docs, {i: x for i, _, x in rows}


def test_toxicity_on_held_out_rows(spark, model):
    learnt, docs, truth = model
    out = toxicity.score(docs, learnt, keep=["doc_id"]).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id")))
    rows = [r for r in out.collect() if r["held"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 80
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert {"idiot", "loser", "worthless", "disgusting", "scum"} <= {t for t, k, _ in learnt.terms if k == 0}


def test_context_parts_quotation_from_abuse(spark, model):
    learnt = model[0]
    texts = [
        "you are an idiot and a loser", 'they said "idiot and loser" again', "you are an id1ot and a l0ser", "tanash revurn", None, "", "IDIOT!! Loser.",
        "idiot\nand \"quoted\" loser", "\"idiot", "x" * 50_000 + " idiot " + "tanash " * 20_000,
    ]
    out = {r["doc_id"]: r for r in toxicity.score(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), learnt, spans=True).collect()}
    mass = {i: sum(h["mass"] for h in r["hits"]) for i, r in out.items()}
    assert mass[1] < 0.2 * mass[0] and out[1]["score"] < out[0]["score"] and [h["quoted"] for h in out[1]["hits"]] == [True, True]
    assert [h["term"] for h in out[2]["hits"]] == ["idiot", "loser"] and [(h["start"], h["end"]) for h in out[0]["hits"]] == [(11, 16), (23, 28)]
    assert out[3]["hits"] == out[4]["hits"] == out[5]["hits"] == [] and out[3]["score"] == out[4]["score"] == out[5]["score"] < 0.5
    assert len(out[6]["hits"]) == 2 and [h["quoted"] for h in out[7]["hits"]] == [False, False] and not out[8]["hits"][0]["quoted"]
    assert [(h["start"], h["end"]) for h in out[9]["hits"]] == [(50_001, 50_006)]


def test_misspelt_terms_spare_known_words(spark):
    """A word of clean texts one edit away from a term is no misspelt term."""
    rows = [(i, f"tone rest {'closer loss' if i % 2 else 'moved'} w{i % 7}" + (" loser loser" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(500)]
    docs = spark.createDataFrame([(i, f"{t} {i}", x) for i, t, x in rows], "doc_id long, text string, x int")
    learnt = toxicity.learn(docs, docs.selectExpr("doc_id", "x as toxic"))
    probe = spark.createDataFrame([(1, "a closer look"), (2, "a lozer look"), (3, "a loser")], "doc_id long, text string")
    out = {r["doc_id"]: [h["term"] for h in r["hits"]] for r in toxicity.score(probe, learnt, spans=True).collect()}
    assert out == {1: [], 2: ["loser"], 3: ["loser"]}


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(50)], [(i, 1) for i in range(50)]])
def test_toxicity_without_both_labels(spark, labels):
    docs = frame(spark, [(i, f"text number {i}", "en") for i in range(50)])
    learnt = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    share = 1.0 if labels and labels[0][1] else 0.0
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, learnt, spans=True).collect()} == {(share, int(share))}
    assert toxicity.score(frame(spark, []), learnt).count() == 0
