"""Personal data written in ways that no training form has: what is found, and what is left alone."""

from __future__ import annotations

import random

from fieldtally.llm import personal

BEFORE = ["please call", "my number is", "write to", "reach me under", "it was", "see", "the entry", "und dann", "le code"]
AFTER = ["today.", "for the rest", "", "and then we left.", "- thanks", "bitte", "(new)"]


def luhn_number(rng):
    body = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(body))
    return "".join(map(str, body)) + str(-total % 10)


def spans(rng):
    """{form: text} of one draw: personal data in forms of their own, and what only looks like it."""
    a, b, c = rng.randrange(201, 990), rng.randrange(200, 999), f"{rng.randrange(10_000):04d}"
    n, name, host = luhn_number(rng), rng.choice(["ann.lee", "bob", "j_smith7", "info"]), rng.choice(["mail", "post4", "uni-town"])
    q = [str(rng.randrange(1, 255)) for _ in range(4)]
    data = {
        "phone bracket without space": f"({a}){b}-{c}", "phone mixed signs": f"{a} {b}-{c}", "phone dot and hyphen": f"{a}.{b}-{c}",
        "email brace": f"{name}{{at}}{host}{{dot}}org", "email bracket spaced": f"{name} (at) {host} (dot) org", "email half spelt": f"{name} [at] {host}.org",
        "card mixed signs": f"{n[:4]}-{n[4:8]} {n[8:12]}-{n[12:]}", "card dots in pairs": ".".join([n[:4], n[4:8], n[8:12], n[12:]]),
        "ip last dot hidden": ".".join(q[:3]) + "[.]" + q[3],
    }
    other = {
        "date": f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", "date with slashes": f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/2024",
        "version": f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}", "years": f"19{rng.randrange(50, 99)}-20{rng.randrange(10, 30)}", "order number": f"{rng.randrange(10_000, 99_999)}-{rng.randrange(1000, 9999)}",
        "time and price": f"{rng.randrange(24)}:30 {rng.randrange(9, 99)}.50", "large number": f"{rng.randrange(1, 9)},{b},{rng.randrange(100, 999)}", "sentence": f"look at {host} dot matrix printers",
    }
    return data, other


def measured(spark, docs, draws=60):
    """{form: share of draws found whole (data) or touched at all (other)}"""
    rng, rows, known = random.Random(11), [], []
    for _ in range(draws):
        data, other = spans(rng)
        for good, forms in ((True, data), (False, other)):
            for form, span in forms.items():
                lead = rng.choice(BEFORE) + " "
                rows.append((-1 - len(rows), lead + span + " " + rng.choice(AFTER)))
                known.append((form, good, len(lead), len(lead) + len(span)))
    found = personal.personal(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")))
    hits, total = {}, {}
    for r in found.where("doc_id < 0").collect():
        form, good, start, end = known[-1 - r.doc_id]
        places = [(s["start"], s["end"]) for s in [*r.base, *r.extra]]
        hits[form, good] = hits.get((form, good), 0) + ((start, end) in places if good else bool(places))
        total[form, good] = total.get((form, good), 0) + 1
    return {k: hits[k] / total[k] for k in total}


def test_forms_from_elsewhere(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.1") + "/documents.parquet").where("text like '%@%' or text like '%555%'")
    shares = measured(spark, docs)
    print({k: round(v, 2) for k, v in shares.items()})
    good = [v for (_, g), v in shares.items() if g]
    bad = [v for (_, g), v in shares.items() if not g]
    assert sum(good) / len(good) >= 0.6 and sum(bad) / len(bad) <= 0.05
