"""Personal data by weak supervision, in DataFrame functions throughout.

Base spans are the leftmost matches of four patterns that pass their checks.
Candidates beyond them (numbers of cards and telephones that a base pattern runs
together with other digits, or that lack a country code or check digit, and
addresses with a written-out at sign) are judged by weak supervision: labelers by
regular expression, word list and context vote on base spans and candidates
alike, expectation-maximisation on the counts of vote patterns estimates how
reliable each labeler is, and a logistic span classifier is trained on the
resulting probabilities. It does not see the votes of the word lists but the
span: digits, separators, what stands left and right, words nearby, check digits.
Candidates that it gives ``ADD_AT`` or more are added.

Only counts come to the driver: of vote patterns (at most 3 ** 5 for each of four
kinds) and of spans alike in all features (at most 5,040 for each). The texts are
read once; spans are stored in the shared folder.

Work is linear in a text and its matches: offsets are running sums, candidates and
base spans meet in sweeps over sorted spans, both in blocks of ``BLOCK``, so that
no array grows one by one beyond that.

The patterns are written with possessive loops and look-behind, which find the
same matches as the plain forms in time linear in the text and without
recursion, so long runs of digits or letters do no harm.

Defined cases: null and empty texts have no spans; of equal starts the kinds
come in the order email, ip, card, phone; candidates that touch a base span or
an earlier candidate are dropped; repeated rows each get their result; without
any span no classifier is needed; an empty table gives no rows; other columns
are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import col, stored

KINDS = ("email", "ip", "card", "phone")

#: Same matches as the plain patterns in KIND_PATTERNS of the tests.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Wider patterns of candidates.
WRITTEN_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++"
NUMBER = r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
SHORT_PHONE = r"(?<![0-9+(.-])(?:\+[0-9]{1,3} ?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"

#: Fixed word lists of the labelers.
CONTEXT = {
    "email": "e-?mails?|mails?|contacts?|write|address|courriel|correo|kontakt",
    "ip": "ips?|hosts?|servers?|address(?:es)?|logins?|clients?|from",
    "card": "cards?|visa|mastercard|amex|credit|payment|account|carte|tarjeta|karte",
    "phone": "phones?|tel|calls?|mobile|fax|dial|telefon|appel|llama",
}
DOMAINS = (
    r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|app|dev|co|me|tv|"
    r"ar|at|au|be|br|ca|ch|cl|cn|cz|de|dk|es|eu|fi|fr|gr|hu|ie|il|in|it|jp|kr|mx|nl|no|nz|pl|pt|ro|ru|se|sg|tr|ua|uk|us|za)$"
)
LOCAL_NETS = r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

LABELERS = ("checked", "listed", "context", "alone", "usual")
NEAR = 40
#: The chance that check digits are right, in personal spans and in others.
CHECKED = (0.98, 0.1)
#: Least probability of a candidate that is added.
ADD_AT = 0.9


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _passes(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$")
    n = F.length(_digits(x))
    return n.between(14, 19) & F.call_function("luhn_check", _digits(x)) if kind == "card" else n.between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column, before: Column, after: Column) -> list[Column]:
    """The votes of the five labelers on a match and the text around it."""
    n = F.length(_digits(x))
    listed = {
        "email": _vote(x.rlike(DOMAINS), F.lit(False)),
        "ip": _vote(F.lit(False), x.rlike(LOCAL_NETS)),
        "card": _vote(_digits(x).rlike(ISSUERS), _digits(x).rlike("^0")),
        "phone": _vote(x.rlike(CODES), F.lit(False)),
    }[kind]
    usual = {
        "email": _vote(F.length(x) <= 64, F.length(x) > 254),
        "ip": _vote(x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), x.rlike("[0-9]{4}")),
        "card": _vote(n.between(15, 16), (n < 13) | (n > 19)),
        "phone": _vote(n.between(10, 13), (n < 9) | (n > 15)),
    }[kind]
    apart = before.rlike(r"(?:^|[\s(,;:\"'])$") & after.rlike(r"^(?:$|[\s),;:.!?\"'])")
    joined = before.rlike(r"[\p{L}\p{N}=_/]$") | after.rlike(r"^[\p{L}\p{N}=_/]")
    return [
        _vote(_passes(kind, x), ~_passes(kind, x)), listed,
        _vote(before.rlike(rf"(?i)\b(?:{CONTEXT[kind]})\b"), F.lit(False)),
        _vote(apart, joined), usual,
    ]


#: What the span classifier sees, and how many values each has, from 0.
FEATURES = {"digits": 7, "style": 5, "left": 4, "right": 4, "near": 3, "check": 3}


def _features(x: Column, before: Column, after: Column, votes: dict[str, Column]) -> list[Column]:
    n, plain = F.length(_digits(x)), F.regexp_replace(x, "[^ ().-]", "")
    digits = F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 15, 4).when(n < 17, 5).otherwise(6)
    style = F.when(plain == "", 0).when(plain.rlike("^ +$"), 1).when(plain.rlike("^-+$"), 2).when(plain.rlike(r"^\.+$"), 3).otherwise(4)

    def side(c):
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}_=/+]"), 3).otherwise(2)

    return [digits, style, side(F.right(before, F.lit(1))), side(F.left(after, F.lit(1))), votes["context"] + 1, votes["checked"] + 1]


_SPAN = f"struct<start:int,kind:int,end:int,base:boolean,{','.join(f'{x}:int' for x in [*LABELERS, *FEATURES])}>"
#: Arrays grow one by one up to so many elements.
BLOCK = 256


def _folded(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays that step(state, item) -> (state, array of ``kind``) gives for the items in turn, joined.
    ``items`` should be a column, as each block takes its slice of it."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc, x):
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc, b):
        joined = lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))
        return F.aggregate(F.slice(items, b * BLOCK + 1, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), one, joined)

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    every = F.aggregate(blocks, F.struct(zero.alias("state"), nothing.alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, every).otherwise(none)


def _matches(parts: Column, found: Column, ends: Column, kind: str, base: bool) -> Column:
    """The spans of a pattern, in order, from the text between its matches, the matches
    (null: none) and their ends; ``base``: whether a match that passes is a base span."""
    k = KINDS.index(kind)

    def span(x, i):
        end = F.get(ends, i)
        last = F.coalesce(F.concat(F.right(F.get(parts, i - 1), F.lit(NEAR)), F.right(F.get(found, i - 1), F.lit(NEAR))), F.lit(""))
        near, after = F.right(F.concat(last, F.get(parts, i)), F.lit(NEAR)), F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(2))
        votes = dict(zip(LABELERS, _votes(kind, x, near, after)))
        return F.struct(end - F.length(x), F.lit(k), end, F.lit(base) & _passes(kind, x), *votes.values(), *_features(x, near, after, votes)).cast(_SPAN)

    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.transform(found, span)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, more: sorted base spans and candidates of every row, with votes."""
    text = F.coalesce(F.col("t"), F.lit(""))
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("t")).withColumns({"t": text, "d": F.col("t").rlike("[0-9]")})
    t, d = F.col("t"), F.col("d")
    wanted = [
        (EMAIL, "email", True, t.contains("@")),
        (IP, "ip", True, d & t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        (CARD, "card", True, d & t.rlike(r"[0-9](?:[ -]?+[0-9]){12}")),
        (PHONE, "phone", True, d & t.contains("+")),
        (WRITTEN_EMAIL, "email", False, t.rlike(r"(?i)[(\[]at[)\]]")),
        (NUMBER, "card", False, d & t.rlike(NUMBER)),
        (SHORT_PHONE, "phone", False, d & t.rlike(r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}")),
    ]
    # columns of their own, so that each pattern runs once over a text
    cut = own.select("doc_id", *[F.when(only, F.split(t, pattern, -1)).alias(f"p{i}") for i, (pattern, _, _, only) in enumerate(wanted)], *[F.when(only, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias(f"m{i}") for i, (pattern, _, _, only) in enumerate(wanted)])
    # where each match ends: the running sum of the lengths of matches and of what stands before them
    size = lambda part: lambda x, i: F.length(x) + F.length(F.get(part, i))
    cut = cut.select("*", *[F.transform(f"m{i}", size(f"p{i}")).alias(f"l{i}") for i in range(len(wanted))])
    cut = cut.select("*", *[F.when(F.size(f"m{i}") > 0, _folded(F.col(f"l{i}"), F.lit(0), "int", lambda at, n: (at + n, F.array(at + n)))).alias(f"e{i}") for i in range(len(wanted))])
    found = cut.select("doc_id", *[_matches(F.col(f"p{i}"), F.col(f"m{i}"), F.col(f"e{i}"), kind, base).alias(f"s{i}") for i, (_, kind, base, _) in enumerate(wanted)])
    every = {own: F.concat(*[f"s{i}" for i, (_, _, base, _) in enumerate(wanted) if base == own]) for own in (True, False)}
    return found.select("doc_id", F.array_sort(F.filter(every[True], lambda x: x["base"])).alias("base"), F.array_sort(every[False]).alias("more"))


def _apart(s: DataFrame) -> DataFrame:
    """Without candidates that touch a base span or an earlier candidate that is kept.

    Three sweeps: from the left past the ends of base spans, from the right past
    their starts, and from the left over the candidates that are still there.
    """
    none, far = F.array().cast(f"array<{_SPAN}>"), 2**31 - 1

    def only(x, yes):
        return F.when(yes, F.array(x)).otherwise(none)

    left = _folded(F.col("more"), F.lit(0), _SPAN, lambda to, x: (F.when(x["base"], F.greatest(to, x["end"])).otherwise(to), only(x, x["base"] | (x["start"] >= to))))
    right = _folded(F.col("more"), F.lit(far), _SPAN, lambda to, x: (F.when(x["base"], F.least(to, x["start"])).otherwise(to), only(x, ~x["base"] & (x["end"] <= to))))
    kept = _folded(F.col("more"), F.lit(0), _SPAN, lambda to, x: (F.when(x["start"] >= to, x["end"]).otherwise(to), only(x, x["start"] >= to)))
    some = F.size("more") > 0
    s = s.withColumn("more", F.when(some, F.array_sort(F.concat("base", "more"))).otherwise(none))
    for swept in (left, F.reverse(F.col("more")), right, F.reverse(F.col("more")), kept):
        s = s.withColumn("more", F.when(some, swept).otherwise(none))
    return s


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Expectation-maximisation on (votes, count): the share of personal spans, per labeler the
    chance of each vote given personal or not, and the probability of each pattern.

    What is known of the first labeler, check digits, counts as much as the spans do: they
    fail for nine in ten of other numbers (``CHECKED`` has the chances that they are right).
    """
    k = len(patterns[0][0])
    post = [1 / (1 + math.exp(-1.5 * (sum(v) + 2 * v[0]))) for v, _ in patterns]
    share, given = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        share = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        given = []
        for j in range(k):
            yes, no = {-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}
            for table, right in zip((yes, no), CHECKED if j == 0 else ()):
                table[1] += right * total
                table[-1] += (1 - right) * total
            for p, (v, n) in zip(post, patterns):
                yes[v[j]] += p * n
                no[v[j]] += (1 - p) * n
            sy, sn = sum(yes.values()), sum(no.values())
            given.append({x: (yes[x] / sy, no[x] / sn) for x in yes})
        post = []
        for v, _ in patterns:
            z = math.log(share / (1 - share)) + sum(math.log(given[j][v[j]][0] / given[j][v[j]][1]) for j in range(k))
            post.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
    return share, given, post


def classifier(rows: list[tuple[tuple[int, ...], int, float]], steps: int = 400) -> dict[tuple[int, int], float]:
    """Logistic weights of (feature, value), and of (-1, 0) for the bias, fitted to rows of
    features, how many spans have them, and the sum of their probabilities."""
    active = [[(-1, 0), *enumerate(f)] for f, _, _ in rows]
    weight = [math.log1p(n) for _, n, _ in rows]
    total, w = sum(weight), {x: 0.0 for a in active for x in a}
    speed = dict(w)
    for _ in range(steps):
        grad = {x: 1e-4 * v for x, v in w.items()}
        for a, m, (_, n, p) in zip(active, weight, rows):
            z = sum(w[x] for x in a)
            e = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p / n) * m / total
            for x in a:
                grad[x] += e
        speed = {x: 0.9 * v - grad[x] for x, v in speed.items()}
        w = {x: v + speed[x] for x, v in w.items()}
    return w


def _scores(table: DataFrame) -> dict[int, dict[tuple[int, int], float]]:
    """The classifier of each kind, from the counts of vote patterns and of spans alike."""
    each = table.select(F.explode(F.concat("base", "more")).alias("x")).select("x.*")
    votes: dict[int, list] = {}
    counts = each.groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))
    for r in counts.orderBy("kind", *LABELERS).collect():  # at most 4 * 3 ** 5 rows
        votes.setdefault(r["kind"], []).append((tuple(r[n] for n in LABELERS), r["n"]))
    known = [(k, *v, p) for k, found in votes.items() for (v, _), p in zip(found, reliabilities(found)[2])]
    if not known:
        return {}
    judged = table.sparkSession.createDataFrame(known, ", ".join(f"{x} int" for x in ("kind", *LABELERS)) + ", p double")
    alike = each.join(F.broadcast(judged), ["kind", *LABELERS]).groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    rows: dict[int, list] = {}
    for r in alike.orderBy("kind", *FEATURES).collect():  # at most 4 times the product of FEATURES
        rows.setdefault(r["kind"], []).append((tuple(r[n] for n in FEATURES), r["n"], r["p"]))
    return {k: classifier(v) for k, v in rows.items()}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of spans (start, kind, end, ...), sorted, of every row."""
    table = stored(_apart(spans(docs, id_col, text_col)), "pii-spans")
    weights = _scores(table)

    def personal(x: Column) -> Column:
        out = F.lit(False)
        for kind, w in weights.items():
            z = F.lit(w[-1, 0])
            for i, (name, values) in enumerate(FEATURES.items()):
                z = z + F.get(F.array(*[F.lit(w.get((i, v), 0.0)) for v in range(values)]), x[name])
            out = F.when(x["kind"] == kind, z >= math.log(ADD_AT / (1 - ADD_AT))).otherwise(out)
        return out

    added = F.filter("more", personal)
    return table.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _named(spans_: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row."""
    found = find(docs, id_col, text_col)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_named("base"), 256).alias("base_sha256"), _named("spans").alias("spans"))
