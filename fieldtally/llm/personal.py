"""Personal data: wide generators propose spans, boosted trees judge them, calibrated thresholds select.

DataFrame operations only. Four fixed rules find the base spans. Generators propose what the rules are too
narrow for (numbers without a plus, dotted or bracketed forms, addresses with words for their signs), several
readings for one place, and of a run of digit groups every part that a kind allows. Gradient-boosted trees
over format and context features score each reading; they are fitted on all of the table's own
different base spans, rewritten into other forms, against broken ones; rows that look alike are one with a weight. The fitted trees
become one column expression, so that scoring needs no join. Thresholds by kind are the lowest that reach
the wanted precision on rows kept from the fit. Added spans never overlap base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bound
from ..operators.windows import position
from .common import column, discard, read_table, table

KINDS = ("email", "ip", "card", "phone")

#: The fixed rules, leftmost and non-overlapping. Possessive loops and the look-behinds change no match: they
#: keep long runs of the same characters linear.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule or generator to be tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": "\\+[0-9]"}
_SIGN = r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
GENERATORS = {
    "spelt": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _SIGN + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++", r"(?i)[ (\[{]dot[ )\]}]"),
    "spaced": (r"[+(]?[0-9](?:[\x20().\-]{0,2}[0-9])++", r"[0-9][ ().\-]{1,2}[0-9]"),
    "joined": (r"(?<![0-9])[0-9]++(?:(?:[.\-/]|\[\.\])[0-9]++)++", r"[0-9](?:[.\-/]|\[\.\])[0-9]"),
}
#: Kinds that a generator's span may be.
READINGS = {"spelt": ("email",), "spaced": ("phone", "card"), "joined": ("phone", "card", "ip")}
#: Generators whose matches are runs of digit groups, of which every part is proposed too.
RUNS = ("spaced", "joined")
#: Fewest digits of a phone without its country code, and most digits and groups of any kind.
LOCAL, LONGEST = 7, 19
BEFORE, AFTER = 24, 8

#: Spans of each kind that :func:`sample` shows.
SAMPLE = 3000
#: Different rows of numbers that one task of the fit is meant to hold.
ROWS = 100_000
TREES, DEPTH, STEP = 12, 4, 0.4
PRECISION = 0.99

_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
_SCORED = "array<struct<kind:string,start:int,end:int,score:double>>"
_PART = "array<struct<start:int,end:int,match:string,before:string,after:string,whole:boolean>>"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|iban)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|dial)\b",
}


def slices_of(items: Column, n: Column) -> Column:
    """An array cut into arrays of about the square root of ``n``, its size, so that work on both levels stays small."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, step), lambda i: F.slice(items, i, step))).otherwise(F.array(items))


def running(values: Column, kind: str, begin, join) -> Column:
    """For each of ``values`` the ``join`` of all before it, from ``begin``: in two levels, without one long chain of copies."""
    none = F.array().cast(f"array<{kind}>")

    def chain(items, first):
        start = F.struct(first.alias("now"), none.alias("out"))
        return F.aggregate(items, start, lambda acc, v: F.struct(join(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])

    def of_parts(parts):
        whole = F.transform(parts, lambda p: F.aggregate(p, begin, join))
        return bound(chain(whole, begin), lambda firsts: F.flatten(F.zip_with(parts, firsts, chain)))

    return bound(values, lambda v: bound(slices_of(v, F.size(v)), of_parts))


def places(lengths: Column) -> Column:
    """Where pieces of such lengths begin, one after the other."""
    return running(lengths, "int", F.lit(0), lambda a, b: a + b)


#: Matches, of two characters at least, that may stand within the context before and after one.
_BACK, _ON = BEFORE // 2 + 1, AFTER // 2 + 1


def hits(text: Column, pattern: str, need: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, before, after); code points, end exclusive.

    The pieces between the matches and the matches themselves have the lengths that give the positions, and
    their ends and beginnings are the context, so that the work is in proportion to the text.
    """

    def spans(z):
        size = lambda v: F.coalesce(F.length(v), F.lit(0))
        tails, heads = F.transform(z, lambda p: F.right(p["piece"], F.lit(BEFORE))), F.transform(z, lambda p: F.left(p["piece"], F.lit(AFTER)))
        begins = places(F.transform(z, lambda p: size(p["piece"]) + size(p["match"])))

        def found(begins):
            def with_ends(ends):
                def with_heads(starts):
                    def span(i):
                        own = F.get(z, i)
                        start = F.get(begins, i) + F.length(own["piece"])
                        low = F.greatest(i - _BACK, F.lit(0))
                        near = F.zip_with(F.slice(ends, low + 1, i - low), F.transform(F.slice(z, low + 1, i - low), lambda p: p["match"]), lambda a, b: F.concat(a, b))
                        before = F.when(F.length(F.get(ends, i)) == BEFORE, F.get(ends, i)).otherwise(F.right(F.concat(F.array_join(near, ""), F.get(ends, i)), F.lit(BEFORE)))
                        past = F.zip_with(F.slice(starts, i + 2, F.lit(_ON)), F.transform(F.slice(z, i + 2, F.lit(_ON)), lambda p: F.coalesce(p["match"], F.lit(""))), lambda a, b: F.concat(a, b))
                        after = F.when(F.length(F.get(starts, i + 1)) == AFTER, F.get(starts, i + 1)).otherwise(F.left(F.array_join(past, ""), F.lit(AFTER)))
                        return F.struct(
                            start.alias("start"), (start + F.length(own["match"])).alias("end"), own["match"].alias("match"), before.alias("before"), after.alias("after")
                        )

                    return F.transform(F.sequence(F.lit(0), F.size(z) - 2), span)

                return bound(heads, with_heads)

            return bound(tails, with_ends)

        return F.when(F.size(z) > 1, bound(begins, found)).otherwise(F.array().cast(_SPAN))

    # The last piece has no match after it.
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(F.rlike(text, F.lit(need)), bound(pairs, spans)).otherwise(F.array().cast(_SPAN))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    places = F.sequence(F.lit(0), F.length(number) - 1)

    def step(acc, i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return (F.length(number) > 0) & (F.aggregate(places, F.lit(0), step) % 10 == 0)


def parts_fit(match: Column) -> Column:
    """All numbers of a dotted match are at most 255."""
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(plain(p)) <= 3) & (plain(p).cast("int") <= 255))


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return parts_fit(match)
    if kind == "card":
        return F.length(digits(match)).between(13, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def features(kind: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers from the format of a span and from what stands around it."""
    groups = F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))
    number = digits(match)
    count = lambda chars: F.length(match) - F.length(F.regexp_replace(match, f"[{chars}]", ""))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    out = {f"is_{k}": flag(kind == k) for k in KINDS}
    out |= {f"near_{k}": flag(F.rlike(before, F.lit(p))) for k, p in CONTEXT.items()}
    out |= {
        "digits": F.length(number),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(groups), F.lit(0)),
        "shortest": F.coalesce(F.array_min(groups), F.lit(0)),
        "first": F.when(F.size(groups) > 0, F.element_at(groups, 1)).otherwise(0),
        "last": F.when(F.size(groups) > 0, F.element_at(groups, -1)).otherwise(0),
        "dots": count("."),
        "spaces": count(" "),
        "hyphens": count("\\-"),
        "brackets": count("()\\[\\]{}"),
        "slashes": count("/"),
        "letters": count("A-Za-z"),
        "plus": flag(F.rlike(match, F.lit("^\\+"))),
        "luhn": flag(F.length(number).between(13, 19) & luhn(number)),
        "small_parts": flag(parts_fit(match)),
        "bracketed_sign": flag(F.rlike(match, F.lit("(?i)[(\\[{] ?at ?[)\\]}]"))),
        "spelt_sign": flag(F.rlike(match, F.lit("(?i) at .* dot "))),
        "name_marks": flag(F.rlike(match, F.lit("^[A-Za-z]+[0-9._%+-]+"))),
        "glued_before": flag(F.rlike(before, F.lit("[A-Za-z0-9_=\"'/.\\-]$"))),
        "glued_after": flag(F.rlike(after, F.lit("^(?:[A-Za-z0-9_=\"'/]|[.\\-][A-Za-z0-9])"))),
    }
    return {k: v.cast("double") for k, v in out.items()}


def proposals(text: Column) -> dict[str, Column]:
    """Array columns of base spans by kind and of generated spans by generator."""
    found = {k: F.filter(hits(text, RULES[k], NEEDS[k]), (lambda k: lambda s: passes(k, s["match"]))(k)) for k in KINDS}
    return found | {g: hits(text, pattern, need) for g, (pattern, need) in GENERATORS.items()}


#: Ways to rewrite a base span: (kind, pattern, replacement, whether it still is one).
FORMS = [
    ("email", "@", "@", True),
    ("email", "^([^@]+)@(.*)\\.([^.]+)$", "$1 at $2 dot $3", True),
    ("email", "^([^@]+)@(.*)\\.([^.]+)$", "$1(at)$2(dot)$3", True),
    ("email", "^([^@]+)@(.*)\\.([^.]+)$", "$1 [at] $2 [dot] $3", True),
    ("email", "^[^@]*?([A-Za-z]+)[^@A-Za-z]*@.*$", "$1 at the dot com", False),
    ("email", "^([A-Za-z]*)[^@]*@([^.]*).*$", "was at home dot on", False),
    ("phone", "^$", "", True),
    ("phone", "^\\+[0-9]{1,3}[^0-9]+(.*)$", "$1", True),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$1.$2.$3", True),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$1-$2-$3", True),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$1$2$3", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{2})([0-9]{2})$", "20$3-0$4", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{2})([0-9]{2})$", "20$3-12-$4", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$1.$3", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{2})([0-9]{2})$", "$1 $2 $3", False),
    # Numbers with a neighbour's groups, or without some of their own.
    ("phone", "^\\+[0-9]{1,3}[^0-9]+(.*)$", "12 $1", False),
    ("phone", "^\\+[0-9]{1,3}[^0-9]+(.*)$", "2024-12-05 $1", False),
    ("phone", "^\\+[0-9]{1,3}[^0-9]+([^0-9]*[0-9]+)(.*)$", "$1$2 $1", False),
    ("phone", "^\\+[0-9]{1,3}[^0-9]+[^0-9]*[0-9]+[^0-9]*(.*)$", "$1", False),
    ("phone", "^\\+[0-9]{1,3}[^0-9]+(.*?)([0-9]+)$", "$2 $1$2", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$2 $3 $1", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$3 $1 $2", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$3 $1-$2-$3", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$1-$2-$3 $1", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$1-$2-$3 $1-$2", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$2-$3 $1-$2", False),
    ("phone", "^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$", "$2-$3 $1-$2-$3", False),
    ("card", "^$", "", True),
    ("card", "^([0-9]{4}).?([0-9]{4}).?([0-9]{4}).?([0-9]{1,7})$", "$1.$2.$3.$4", True),
    ("card", "^(.*)([0-9])$", "$10", False),
    ("card", "^([0-9]{4}).?([0-9]{4}).?([0-9]{4}).?([0-9]{1,7})$", "$1.$2.$4", False),
    ("card", "^([0-9]{4}).?([0-9]{4}).?([0-9]{4}).?([0-9]{1,7})$", "$1-$2-$3-$1", False),
    ("ip", "^$", "", True),
    ("ip", "\\.", "[.]", True),
    ("ip", "^(?:[0-9]+)", "3$0", False),
    ("ip", "\\.[0-9]+$", "", False),
    ("ip", "\\.[0-9]+\\.[0-9]+$", "", False),
    ("ip", "$", ".7", False),
    ("ip", "\\.", "-", False),
]


def different(spans: DataFrame) -> DataFrame:
    """(kind, match, before, after, h) of all different base spans: copies of a span count once."""
    per = [spans.where(F.size(k) > 0).select(F.explode(k).alias("s")).select(F.lit(k).alias("kind"), "s.match", "s.before", "s.after") for k in KINDS]
    return reduce(DataFrame.union, per).distinct().withColumn("h", F.xxhash64("kind", "match", "before", "after"))


def parted(some: DataFrame) -> DataFrame:
    """Spans with ``kept``: every fourth of a kind, from its first, is kept from the fit.

    So each kind present has some; a kind with one span only is not fitted on. Spans are numbered by a range sort.
    """
    placed = position(some, [F.col(c) for c in ("kind", "h", "match", "before", "after")], "_at_row")
    first = placed.groupBy("kind").agg(F.min("_at_row").alias("_first"))
    return placed.join(first, "kind").select(*some.columns, ((F.col("_at_row") - F.col("_first")) % 4 == 0).alias("kept"))


def sample(spans: DataFrame) -> DataFrame:
    """At most SAMPLE spans of each kind, parted, for a look at them; the trees are fitted on all (:func:`training_rows`)."""
    some = different(spans)
    per = [some.where(F.col("kind") == k).orderBy("h", "match", "before", "after").limit(SAMPLE) for k in KINDS]
    return parted(reduce(DataFrame.union, per))


def training_rows(spans: DataFrame) -> DataFrame:
    """(kind, match, before, after, h, kept, label) from all different base spans: rewritten forms, broken forms, other readings."""
    some = parted(different(spans))
    forms = F.array(*[F.struct(F.lit(k).alias("of"), F.regexp_replace("match", p, r).alias("form"), F.lit(y).alias("label")) for k, p, r, y in FORMS])
    rows = some.select("kind", "before", "after", "h", "kept", F.explode(F.filter(forms, lambda f: f["of"] == F.col("kind"))).alias("f"))
    rows = rows.select("kind", "before", "after", "h", "kept", F.col("f.form").alias("match"), F.col("f.label").alias("label"))
    # A card's broken form may pass by chance.
    rows = rows.where((F.col("kind") != "card") | (F.col("label") == luhn(digits(F.col("match")))))
    others = rows.where("label").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS]))).join(rows.where("label").select("h", "match", F.col("kind").alias("own")).distinct(), ["h", "match"])
    others = others.where("kind <> own").withColumn("label", F.lit(False)).select(*rows.columns)
    # A phone's broken forms are no cards either, also where the check digit fits by chance.
    crossed = rows.where("kind = 'phone' and not label").withColumn("kind", F.lit("card")).select(*rows.columns)
    return rows.union(others).union(crossed).distinct()


def tree(node, names: list[str], feature: dict[str, Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    here = feature[names[split.featureIndex()]] <= F.lit(float(split.threshold()))
    return F.when(here, tree(node.leftChild(), names, feature)).otherwise(tree(node.rightChild(), names, feature))


class Judge:
    """Boosted trees and thresholds, as plain column expressions."""

    def __init__(self, rows: DataFrame):
        at = features(F.col("kind"), F.col("match"), F.col("before"), F.col("after"))
        self.names = list(at)
        # Rows that look alike to the trees are one row with their number as its weight.
        alike = rows.select("kind", "kept", F.col("label").cast("double").alias("label"), *[v.alias(k) for k, v in at.items()])
        data = table(alike.groupBy(*alike.columns).agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-training")
        self.trees, self.least = [], {}
        fit = data.where("not kept")
        if fit.select("label").distinct().count() == 2:
            # Placed by content alone, so that the trees do not depend on how the texts lie; a small table is one part.
            tasks = 1 + fit.count() // ROWS
            placed = fit.repartition(tasks, "kind", *self.names).sortWithinPartitions("kind", "label", *self.names)
            ready = VectorAssembler(inputCols=self.names, outputCol="features").transform(placed)
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=32, weightCol="weight").fit(ready)
            self.trees = list(zip(model.treeWeights, [t.rootNode() for t in model._java_obj.trees()]))
            self.calibrate(data.where("kept"))
        discard(data)

    def score(self, feature: dict[str, Column]) -> Column:
        margin = sum((F.lit(float(w)) * tree(root, self.names, feature) for w, root in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def calibrate(self, kept: DataFrame) -> None:
        grid = [0.5 + i / 100 for i in range(0, 50, 2)]
        scored = kept.select("kind", "label", "weight", self.score({k: F.col(k) for k in self.names}).alias("p"))
        cells = [F.struct(F.lit(t).alias("t"), F.sum(F.when(F.col("p") >= t, F.col("label") * F.col("weight"))).alias("hit"), F.sum(F.when(F.col("p") >= t, F.col("weight")).otherwise(0.0)).alias("all")) for t in grid]
        for row in scored.groupBy("kind").agg(F.array(*cells).alias("cells")).collect():
            good = [c["t"] for c in row["cells"] if c["all"] and c["hit"] >= PRECISION * c["all"]]
            if good:
                self.least[row["kind"]] = min(good)


def parts(run: Column) -> Column:
    """A run of digit groups and its parts, from any group to any later one, with ``whole`` for the run itself.

    A part takes the plus before it, and the bracket if it also holds the closing one. Parts with more than
    LONGEST digits, which no kind has, are left out; what stands around a part comes from run and context. Every
    part is put together from its own groups, so that a long run costs in proportion to its groups.
    """
    pairs = F.arrays_zip(F.split(run["match"], "[0-9]+", -1).alias("piece"), F.regexp_extract_all(run["match"], F.lit("[0-9]+"), F.lit(0)).alias("group"))

    def from_pairs(z):
        n = F.size(z) - 1  # the last piece has no group after it
        sizes = F.transform(z, lambda p: F.coalesce(F.length(p["group"]), F.lit(0)))
        steps = F.transform(z, lambda p: F.length(p["piece"]) + F.coalesce(F.length(p["group"]), F.lit(0)))

        def with_places(at, digit):
            def text(lo, count):
                """Groups with the pieces before them, from one group on."""
                return F.array_join(F.transform(F.slice(z, lo + 1, count), lambda p: F.concat(p["piece"], F.coalesce(p["group"], F.lit("")))), "")

            def from_first(i):
                first = F.get(z, i)
                lead = F.right(first["piece"], F.lit(1))
                start = F.get(at, i) + F.length(first["piece"])
                back = F.greatest(i - BEFORE, F.lit(0))
                # What comes before the group, from within the run and before it.
                ahead = F.right(F.concat(F.when(back == 0, run["before"]).otherwise(F.lit("")), text(back, i - back), first["piece"]), F.lit(BEFORE + 1))
                least = F.coalesce(F.get(digit, i), F.lit(0))

                def to_last(j):
                    held = (F.get(digit, j) + F.get(sizes, j)) - least
                    good = held.between(LOCAL, LONGEST) | (j == i + 3)
                    body = F.concat(first["group"], text(i + 1, j - i))
                    end = F.get(at, j) + F.get(steps, j)
                    on = F.left(F.concat(text(j + 1, F.lit(_ON)), F.when(j + _ON >= n, run["after"]).otherwise(F.lit(""))), F.lit(AFTER))
                    led = (F.length(first["piece"]) > 0) & ((lead == "+") | ((lead == "(") & F.contains(body, F.lit(")"))))
                    plus = F.when(led, 1).otherwise(0)
                    return F.when(
                        good,
                        F.struct(
                            (run["start"] + start - plus).alias("start"), (run["start"] + end).alias("end"),
                            F.concat(F.when(led, lead).otherwise(F.lit("")), body).alias("match"),
                            F.right(F.when(led, F.left(ahead, F.length(ahead) - 1)).otherwise(ahead), F.lit(BEFORE)).alias("before"), on.alias("after"), F.lit(False).alias("whole"),
                        ),
                    )

                return F.filter(F.transform(F.sequence(i, F.least(i + (LONGEST - 1), n - 1)), to_last), lambda p: p.isNotNull())

            return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_first))

        made = bound(places(steps), lambda at: bound(places(sizes), lambda digit: with_places(at, digit)))
        return F.when(n > 0, made).otherwise(F.array().cast(_PART))

    inner = F.filter(bound(pairs, from_pairs), lambda p: (p["start"] > run["start"]) | (p["end"] < run["end"]))
    whole = F.struct(*[run[c].alias(c) for c in ("start", "end", "match", "before", "after")], F.lit(True).alias("whole"))
    return F.concat(F.array(whole), inner)


def possible(kind: str, match: Column) -> Column:
    """Whether a part of a run may be of the kind: its length, for a card also the check digit."""
    if kind == "ip":
        return (F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))) == 4) & parts_fit(match)
    if kind == "phone":
        return F.length(digits(match)).between(LOCAL, 15)
    return passes(kind, match)


def added(judge: Judge) -> Column:
    """Array of (kind, start, end, score) from the generated spans and their parts, none over a base span."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    if not judge.least:
        return none
    readings = []
    for g in GENERATORS:
        proposed = F.flatten(F.transform(F.col(g), parts)) if g in RUNS else F.transform(F.col(g), lambda s: s.withField("whole", F.lit(True)))
        # What lies over a base span is settled already; only the rest is judged.
        free = F.filter(proposed, lambda s: ~overlaps_base(s, F.col("blocks")))
        kinds = [k for k in READINGS[g] if k in judge.least]
        # The one element binds the proposals, so that they are made once for all kinds.
        readings.append(F.flatten(F.transform(F.array(free), lambda f: F.concat(none, *[judged(judge, k, f) for k in kinds]))))
    return F.concat(none, *readings)


def judged(judge: Judge, kind: str, spans: Column) -> Column:
    """(kind, start, end, score) of the spans whose reading as ``kind`` reaches its threshold."""
    may = F.filter(spans, lambda s: s["whole"] | possible(kind, s["match"]))

    def known(s):
        at = features(F.lit(kind), s["match"], s["before"], s["after"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.struct(*[v.alias(k) for k, v in at.items()]).alias("at"))

    def reading(s):
        score = judge.score({k: s["at"][k] for k in judge.names})
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.filter(F.transform(F.transform(may, known), reading), lambda s: s["score"] >= judge.least[kind])


def overlaps_base(s: Column, blocks: Column) -> Column:
    """Whether a span lies over a base span; ``blocks`` (see :func:`base_blocks`) are looked through first."""
    over = lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    return F.exists(blocks, lambda k: over(k) & F.exists(k["spans"], over))


def base_blocks() -> Column:
    """All base spans by place, in blocks of about the square root of their number with the block's start and end."""
    plain = F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    ends = lambda p: F.struct(F.array_min(F.transform(p, lambda s: s["start"])).alias("start"), F.array_max(F.transform(p, lambda s: s["end"])).alias("end"), p.alias("spans"))
    return bound(F.array_sort(plain), lambda v: F.transform(F.filter(slices_of(v, F.size(v)), lambda p: F.size(p) > 0), ends))


def best(spans: Column) -> Column:
    """Spans without overlap: by score, then the earlier, the longer, the first kind; only chosen ones exclude others.

    Spans are parted first where none lies over the next, and chosen part by part.
    """
    kind = "struct<start:int,back:int,loss:double,kind:string>"
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-s["score"]).alias("loss"), s["kind"].alias("kind"))))
    over = lambda a, b: (a["start"] < -b["back"]) & (b["start"] < a["end"])

    def step(chosen, s):
        fresh = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"), (-s["loss"]).alias("score"))
        return F.when(F.exists(chosen, lambda c: over(c, s)), chosen).otherwise(F.concat(chosen, F.array(fresh)))

    def greedy(part):
        order = F.array_sort(F.transform(part, lambda s: F.struct(s["loss"].alias("loss"), s["start"].alias("start"), s["back"].alias("back"), s["kind"].alias("kind"))))
        return F.aggregate(order, F.array().cast(_SCORED), step)

    def parted(v):
        def cut(ends):
            firsts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i)["start"] >= F.get(ends, i))
            return bound(firsts, lambda f: F.flatten(F.transform(f, lambda i, k: greedy(F.slice(v, i + 1, F.coalesce(F.get(f, k + 1), F.size(v)) - i)))))

        return F.when(F.size(v) > 0, bound(running(F.transform(v, lambda s: -s["back"]), "int", F.lit(0), lambda a, b: F.greatest(a, b)), cut)).otherwise(F.array().cast(_SCORED))

    return bound(by_place.cast(f"array<{kind}>"), parted)


def personal(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``extra``: arrays of (kind, start, end).

    Positions are code points, ends exclusive; spans are sorted by kind as listed, then start. A null
    text has none. Without base spans in the table nothing is learnt and nothing added. Repeated rows give
    repeated results; existing columns named ``base`` or ``extra`` are replaced.
    """
    kept = [c for c in docs.columns if (keep is None or c in keep) and c.lower() not in ("base", "extra")]
    body = F.coalesce(column(docs, text).cast("string"), F.lit(""))
    found = docs.select(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(kept)], *[v.alias(k) for k, v in proposals(body).items()])
    # Written once: the fit, the scoring and the result read it, and the patterns run once per text.
    found = table(found, "proposals")
    judge = Judge(training_rows(found))
    scored = found.withColumn("blocks", base_blocks()).withColumn("extra", best(added(judge))).drop("blocks", *GENERATORS)
    plain = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    extra = F.transform(F.array_sort("extra"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    in_order = F.concat(*[of_kind(extra, k) for k in KINDS])
    out = scored.select(*[f"c{i}" for i in range(len(kept))], F.concat(*[plain(k) for k in KINDS]).alias("base"), in_order.alias("extra"))
    return out.toDF(*kept, "base", "extra")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def together(base: Column, extra: Column) -> Column:
    """All spans by kind as listed, then start."""
    both = F.concat(base, extra)
    return F.concat(*[F.array_sort(of_kind(both, k)) for k in KINDS])


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (or overlapping run of spans) replaced by its first kind in capitals and brackets.

    The text is cut once, at the borders of the runs, into pieces of about equal number on two levels.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def runs(v):
        """(start, end, kind) of every overlapping run."""

        def cut(ends):
            firsts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i)["start"] >= F.get(ends, i))
            one = lambda f, i, k: F.struct(
                F.get(v, i)["start"].alias("start"), F.array_max(F.transform(F.slice(v, i + 1, F.coalesce(F.get(f, k + 1), F.size(v)) - i), lambda s: -s["back"])).alias("end"), F.get(v, i)["kind"].alias("kind")
            )
            return bound(firsts, lambda f: F.transform(f, lambda i, k: one(f, i, k)))

        return bound(running(F.transform(v, lambda s: -s["back"]), "int", F.lit(0), lambda a, b: F.greatest(a, b)), cut)

    def put(body, from_, of):
        """``body``, which begins at ``from_``, with the runs ``of`` replaced."""
        begin = F.struct(from_.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc, r):
            piece = F.concat(F.substring(body, acc["at"] - from_ + 1, r["start"] - acc["at"]), F.lit("["), F.upper(r["kind"]), F.lit("]"))
            return F.struct(r["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

        return F.aggregate(of, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] - from_ + 1, F.length(body))))

    def in_blocks(r):
        def joined(blocks):
            low = lambda k: F.when(k == 0, 0).otherwise(F.get(blocks, k)[0]["start"])
            return F.array_join(F.transform(blocks, lambda b, k: put(F.substring(text, low(k) + 1, F.coalesce(F.get(blocks, k + 1)[0]["start"], F.length(text)) - low(k)), low(k), b)), "")

        return bound(slices_of(r, F.size(r)), joined)

    return F.when(F.size(spans) > 0, bound(order, lambda v: bound(runs(v), in_blocks))).otherwise(text)


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    found = personal(read_table(spark, folder, "documents"), keep=["doc_id"])
    number = lambda k: F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(together(F.col("base"), F.col("extra"))).alias("spans"))
