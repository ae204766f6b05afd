"""Personal data in text: base patterns, and spans added by weak supervision. DataFrame functions only.

Candidates come from wide patterns. Three labelers vote on each (yes, no or abstain): the shape of
the value (regex), a gazetteer of known prefixes and endings, and words before it (context).
Dawid-Skene expectation-maximisation estimates how reliable each labeler is for each kind, from
counts of vote patterns; the posterior then trains a logistic span classifier on votes, length and
make-up of the value. Both fits read one aggregated table whose size is bounded by the number of
kinds, votes and feature buckets, never by the corpus. Base spans always stay; candidates that
overlap none are added where the classifier says yes.

Positions come from splitting the text at matches: a start is the length of all gaps and matches
before it, summed in groups, so a text of many matches takes time in proportion to them. Patterns are
written so that every attempt fails or ends in time linear in the text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
BASE = {
    # a match starts where a run of local-part characters starts, or where the last match ended
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with single separators, of 12 to 19 digits
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}+)++",
    "phone_local": r"\((?<![0-9+]\x20?\()[0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "ssn": r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"""(?<=[=:]\x20{0,2}["']?)(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{16,}+""",
}
#: A text without these characters has no match of the kind.
NEEDS = {"email": ["@"], "phone": ["+"], "email_spelled": ["(at)", "[at]"], "phone_local": ["("], "ssn": ["-"], "secret": ["=", ":"]}
KINDS = [*BASE, *ADDED]
SHAPE = {
    "email": r"^[^.@][^@]*@.+\.[A-Za-z]{2,24}$",
    "ip": r"^(?!0)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$",
    "card": r"^[3-6](?:[0-9]{11,18}|[0-9]{3}[\x20-](?:[0-9]{4}[\x20-]){2}[0-9]{1,7})$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20(.-]",
    "email_spelled": r"(?i)dot[\])]\x20?[a-z]{2,24}$",
    "phone_local": r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"(?=.*[0-9])(?=.*[A-Za-z])",
}
# fixed values: generic and country domains in wide use
DOMAINS = """
com org net edu gov mil int info biz name pro io co ai app dev me tv cc xyz online site shop tech cloud
ae ar at au be bg bo br by ca ch cl cn cr cy cz de dk do ec ee eg es eu fi fr ge gr gt hk hn hr hu id ie il in ir is it
jp ke kr kz lb lt lu lv ma md mk mt mx my ng ni nl no np nz pa pe ph pk pl pt py qa ro rs ru sa se sg si sk sv th tn tr
tw tz ua ug uk us uy uz ve vn za
""".split()
#: What lists of issued values say, apart from the form: domains, address blocks, issuers, country codes, areas, key prefixes.
GAZETTEER = {
    "email": rf"(?i)\.(?:{'|'.join(DOMAINS)})$",
    "ip": r"^(?!0*(?:0|127|255|2(?:2[4-9]|[3-4][0-9]))\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5))",
    "phone": r"^\+(?:1|7|2(?:0|7|1[1-368]|[2-6][0-9]|9[01789])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[013])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|7[0-9]|8[0-9]|9[0-2])|8(?:[1246]|0[08]|5[0256]|7[018]|8[0268])|9(?:[0-58]|[67][0-9]|9[2-68]))",
    "email_spelled": rf"(?i)[\])]\x20?(?:{'|'.join(DOMAINS)})$",
    # areas of the North American plan: no service codes, no expansion or reserved blocks
    "phone_local": r"^\((?!.11|37|96)[2-9][0-8][0-9]\)",
    # areas issued before numbers were drawn at random
    "ssn": r"^(?!000|666)(?:[0-6][0-9]{2}|7(?:[0-2][0-9]|3[0-3]|5[0-9]|6[0-9]|7[0-2]))",
    "secret": r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|AKIA[A-Z0-9]+|gh[pousr]_\w+|sk-\w+|xox[abprs]-[\w-]+|AIza[\w-]+|ey[JK][\w-]+)$",
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|correo|kontakt|courriel",
    "ip": r"(?i)\bip\b|host|server|address|from",
    "card": r"(?i)card|visa|credit|carte|karte|tarjeta|pay",
    "phone": r"(?i)tel|phone|call|mobile|fax|ruf",
    "email_spelled": r"(?i)mail|contact|write|correo|kontakt",
    "phone_local": r"(?i)tel|phone|call|mobile|fax",
    "ssn": r"(?i)ssn|social|security",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key|credential)\s{0,2}[=:]\s{0,2}[\"']?$",
}
AGAINST = r"(?i)version|release|isbn|doi|page|chapter|figure|invoice|order"
BEFORE = 24


#: Elements of one group in a running sum, and code points of one block of a text that is cut.
GROUP, BLOCK = 128, 4096


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, merge, zero: int) -> Column:
    """array<int>: the merge of all elements before each. In groups, as adding to an array copies it."""

    def run(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, first, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    start = F.lit(zero).cast("int")
    groups = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(GROUP)), lambda i: F.slice(v, i, GROUP))
    whole = lambda g: F.zip_with(g, run(F.transform(g, lambda x: F.aggregate(x, start, lambda a, b: merge(a, b))), start), lambda x, s: run(x, s))
    return _let(values, lambda v: F.flatten(_let(groups(v), whole)))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of all matches, in code points; before: up to BEFORE code points, of three earlier matches at most."""

    def placed(found: Column) -> Column:
        zipped = F.slice(F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g")), 1, F.size(found))

        def spans(z: Column, at: Column) -> Column:
            tail = lambda x: F.right(x, F.lit(BEFORE))
            past = lambda i, n: F.coalesce(F.concat(tail(F.get(z, i - n)["g"]), tail(F.get(z, i - n)["m"])), F.lit(""))

            def span(x: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(x["g"])
                before = tail(F.concat(past(i, 3), past(i, 2), past(i, 1), tail(x["g"])))
                return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"), before.alias("before"))

            return F.transform(z, span)

        sizes = lambda z: F.transform(z, lambda x: F.length(x["g"]) + F.length(x["m"]))
        return _let(zipped, lambda z: _let(_running(sizes(z), lambda a, b: a + b, 0), lambda at: spans(z, at)))

    none = F.array().cast("array<struct<start: int, end: int, value: string, before: string>>")
    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))
    if kind not in NEEDS:
        return spans
    return F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in NEEDS[kind])), spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def step(total: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str):
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))"
        return lambda x: x["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return lambda x: _luhn(x["value"])
    if kind == "phone":
        return lambda x: F.length(_digits(x["value"])).between(9, 15)
    return lambda x: F.lit(True)


def _votes(kind: str, before: Column, value: Column) -> list[Column]:
    yes = lambda ok: F.when(ok, 1).otherwise(-1)
    context = F.when(before.rlike(AGAINST), -1).when(before.rlike(CONTEXT[kind]), 1).otherwise(0)
    return [yes(value.rlike(SHAPE[kind])), yes(value.rlike(GAZETTEER[kind])), context]


def candidates(text: Column) -> Column:
    """array of struct(kind, start, end, v0, v1, v2, size, made), by kind, then start."""
    out = []
    for nth, kind in enumerate(KINDS):
        spans = _matches(text, kind, (BASE | ADDED)[kind])
        if kind in BASE:
            spans = F.filter(spans, _valid(kind))
        out.append(F.transform(spans, _described(kind, nth)))
    return F.concat(*out)


def _described(kind: str, nth: int):
    def describe(x: Column) -> Column:
        votes = [v.alias(f"v{i}") for i, v in enumerate(_votes(kind, x["before"], x["value"]))]
        size = F.when(F.length(x["value"]) >= 24, 2).when(F.length(x["value"]) >= 12, 1).otherwise(0)
        made = x["value"].rlike("[0-9]").cast("int") + x["value"].rlike("[A-Za-z]").cast("int")
        return F.struct(F.lit(nth).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *votes, size.alias("size"), made.alias("made"))

    return describe


LABELERS = 3
FEATURES = ["v0", "v1", "v2", "size", "made"]


def em(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior that a candidate is personal data, by (kind, votes); counts: (kind, votes, number)."""
    out = {}
    for kind in {k for k, _, _ in counts}:
        rows = [(v, n) for k, v, n in counts if k == kind]
        prior, right = 0.5, [[0.8, 0.8] for _ in range(LABELERS)]  # of each labeler: P(yes | true), P(no | false)
        post: dict[tuple[int, ...], float] = {}
        for _ in range(rounds):
            for v, _ in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for i, x in enumerate(v):
                    if x:
                        a += math.log(right[i][0] if x > 0 else 1 - right[i][0])
                        b += math.log(1 - right[i][1] if x > 0 else right[i][1])
                post[v] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
            total = sum(n for _, n in rows)
            # a beta prior keeps labelers better than chance, so the classes cannot swap
            prior = min(0.95, max(0.05, (sum(post[v] * n for v, n in rows) + 1) / (total + 2)))
            for i in range(LABELERS):
                for side in (0, 1):
                    w = [(v[i], n * (post[v] if side == 0 else 1 - post[v])) for v, n in rows if v[i]]
                    good = sum(x for s, x in w if (s > 0) == (side == 0))
                    right[i][side] = min(0.99, max(0.55, (good + 8) / (sum(x for _, x in w) + 10)))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def _vector(kind: int, features: tuple[int, ...]) -> dict[str, float]:
    x = {f"kind{kind}": 1.0, "one": 1.0}
    for name, value in zip(FEATURES, features):
        x[f"{name}={value}"] = 1.0
    return x


def train(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[str, float]:
    """Weights of the span classifier; counts: (kind, FEATURES, number)."""
    by: dict[tuple[int, tuple[int, ...]], int] = {}
    for kind, f, n in counts:
        by[kind, f[:LABELERS]] = by.get((kind, f[:LABELERS]), 0) + n
    post = em([(k, v, n) for (k, v), n in sorted(by.items())])
    data = [(_vector(k, f), post[k, f[:LABELERS]], math.log1p(n)) for k, f, n in sorted(counts)]
    weight: dict[str, float] = {}
    total = sum(n for *_, n in data) or 1.0
    for _ in range(300):
        grad: dict[str, float] = {}
        for x, y, n in data:
            z = sum(weight.get(name, 0.0) for name in x)
            g = n * (1 / (1 + math.exp(-min(50, max(-50, z)))) - y)
            for name in x:
                grad[name] = grad.get(name, 0.0) + g
        for name, g in grad.items():
            weight[name] = weight.get(name, 0.0) - 1.0 * (g / total + 1e-4 * weight.get(name, 0.0))
    return weight


def fit(documents: DataFrame) -> dict[str, float]:
    """Classifier weights from all rows of documents (text); reads a table of counts bounded by kinds and feature values."""
    rows = documents.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    counts = rows.groupBy("c.kind", *(f"c.{f}" for f in FEATURES)).count().collect()
    return train([(r["kind"], tuple(r[f] for f in FEATURES), r["count"]) for r in counts])


def _score(c: Column, weight: dict[str, float]) -> Column:
    score = F.lit(weight.get("one", 0.0))
    for name, w in sorted(weight.items()):
        if name.startswith("kind"):
            score = score + F.when(c["kind"] == int(name[4:]), w).otherwise(0.0)
        elif "=" in name:
            feature, value = name.split("=")
            score = score + F.when(c[feature] == int(value), w).otherwise(0.0)
    return score


def pii_spans(text: Column, weight: dict[str, float]) -> Column:
    """array<struct<start, kind, end>> in order: base spans, and candidates the classifier accepts that overlap no base span."""
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    far = 2**31 - 1
    is_base = lambda x: x["kind"] < len(BASE)
    shape = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    def apart(sorted_: Column) -> Column:
        """Base spans come before others of the same start, so a base span overlaps one that ends behind its start before it or starts before its end behind it."""
        ends = _running(F.transform(sorted_, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest, 0)
        starts = F.reverse(_running(F.reverse(F.transform(sorted_, lambda x: F.when(is_base(x), x["start"]).otherwise(far))), F.least, far))
        keep = lambda before, behind: F.filter(sorted_, lambda x, i: is_base(x) | ((F.get(before, i) <= x["start"]) & (F.get(behind, i) >= x["end"])))
        return _let(ends, lambda before: _let(starts, lambda behind: keep(before, behind)))

    def pick(all_: Column) -> Column:
        chosen = F.filter(all_, lambda x: is_base(x) | (_score(x, weight) > 0))
        return _let(F.array_sort(shape(chosen)), lambda a: F.when(F.exists(a, lambda x: ~is_base(x)), apart(a)).otherwise(a))

    return F.coalesce(_let(candidates(text), pick), none)


def find_pii(documents: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """documents with spans: array<struct<start, kind, end>> (code points, end exclusive; kind indexes KINDS), by start, then kind.

    A null text counts as empty; a text of any length is searched as a whole. Spans of one start are
    ordered by kind. Rows are independent, so repeated rows get equal spans; an empty table gives an
    empty table; other columns stay as they are, but for one named spans, which is replaced.
    """
    weight = fit(documents) if weight is None else weight
    return documents.withColumn("spans", pii_spans(F.coalesce("text", F.lit("")), weight))


def label(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redact(documents: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """documents with each span of the text replaced by its kind in brackets; overlapping spans give one. A null text stays null."""
    weight = fit(documents) if weight is None else weight
    found = documents.withColumn("spans_pii_", pii_spans(F.coalesce("text", F.lit("")), weight))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        i, j = (a / BLOCK).cast("int"), (b / BLOCK).cast("int")
        over = F.concat(F.get(blocks, i).substr(a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.coalesce(F.get(blocks, j).substr(F.lit(1), b % BLOCK), F.lit("")))
        return F.when(a >= b, F.lit("")).when(i == j, F.get(blocks, i).substr(a % BLOCK + 1, b - a)).otherwise(over)

    def replaced(blocks: Column, ends: Column) -> Column:
        one = lambda x, i: F.when(x["start"] >= F.get(ends, i), F.concat(cut(blocks, F.get(ends, i), x["start"]), F.element_at(names, x["kind"] + 1))).otherwise(F.lit(""))
        last = F.greatest(F.get(ends, F.size(ends) - 1), F.element_at("spans_pii_", -1)["end"])
        return F.concat(F.array_join(F.transform("spans_pii_", one), ""), cut(blocks, last, F.length("text")))

    ends = _running(F.transform("spans_pii_", lambda x: x["end"]), F.greatest, 0)
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    text = _let(blocks, lambda b: _let(ends, lambda e: replaced(b, e)))
    return found.withColumn("text", F.when(F.size("spans_pii_") > 0, text).otherwise(F.col("text"))).select(*documents.columns)
