r"""Personal data by weak supervision, in DataFrame functions alone.

Base spans come from fixed patterns: email, ip, card (Luhn) and phone.  Beyond
them, looser patterns propose candidates (credentials, phone numbers without a
country code, spelled-out emails, names after a form of address).  Labelers of
three sorts vote on each candidate: regex (a strict shape), gazetteer (a table
of known words of each kind, looked up for the candidate's words and the two
before it) and context (assignment, quotes, neighbours).  Counts of
the vote patterns, a table bounded by the number of patterns, go to the driver,
where expectation-maximisation estimates each labeler's reliability without
any labels.  Its posteriors train a logistic span classifier on the candidates'
shape and context bits, again from bounded counts.  Candidates that it accepts
and that touch no base span are added; base spans always stay.

Null and empty texts have no spans.  Rows repeat as they come, a null id stays
null, an empty table gives an empty result; columns other than the id and the
text are not read.  Offsets count code points, the end is exclusive.

The patterns are written so that Java's matcher neither recurses nor rescans:
possessive repeats where what follows cannot need a shorter one, and a match
may only begin where a run begins or where the last match ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm._state import Scratch, read_table

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
#: Whole chains of digits with single separators, 14 to 19 of them.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Loose patterns of the method's own kinds.
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
    "local_phone": r"(?<![0-9+.(-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "spelled_email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?[\[(]?(?:at|AT)[\])]?\x20?[A-Za-z0-9-]{{1,63}}+\x20?[\[(]?(?:dot|DOT)[\])]?\x20?[A-Za-z]{{2,12}}",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
KINDS = (*BASE_KINDS, *LOOSE)
#: A cheap test that any text with a candidate passes.
HINT = {"secret": r"[A-Za-z0-9_-]{20}", "local_phone": r"[0-9]{3}[-.\x20][0-9]{4}", "spelled_email": r"(?:dot|DOT)", "name": r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?\x20[A-Z]"}
#: The default gazetteer, (kind, entry) with the entries in lower case.
_CREDENTIALS = "token key secret password passwd pwd auth bearer credential credentials apikey sk pk ghp gho akia xox glpat"
_CALLS = "phone tel telephone call mobile cell fax contact dial ring whatsapp"
_MAIL = "mail email write contact gmail yahoo hotmail outlook protonmail com org net edu info"
_NAMES = (
    "name dear sincerely regards anna maria mary elena laura sarah emma julia sophie carla john james michael david peter paul thomas robert "
    "carlos luis jose juan antonio miguel marie pierre jean claude louis camille hans klaus karl otto ingrid heidi smith jones brown garcia "
    "martinez lopez silva dubois martin bernard müller schmidt weber fischer"
)
GAZETTEER = [(kind, word) for kind, words in (("secret", _CREDENTIALS), ("local_phone", _CALLS), ("spelled_email", _MAIL), ("name", _NAMES)) for word in words.split()]
#: A gazetteer's entries, at most: they are constants of the plan.
ENTRIES = 20_000
CONTEXT = 24
_BLOCK = 64


def _spans(text: Column, pattern: str, hint: Column) -> Column:
    """array<struct<start, ord, end, kind, value>> of all matches, in order.

    The pieces between matches and the matches themselves give the offsets.
    Running sums are taken in blocks, so a text with many matches costs little
    more than in proportion.
    """
    found = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value"), (F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))).alias("step")),
    )
    return F.when(hint, found)


def _located(parts: str, sums: str, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.expr(f"""
        filter(transform({parts}, (x, i) -> named_struct(
            'start', element_at({sums}, CAST(i DIV {_BLOCK} AS INT) + 1) + aggregate(slice({parts}, CAST(i DIV {_BLOCK} AS INT) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, y) -> a + y.step) + x.gap,
            'ord', {order}, 'kind', '{kind}', 'value', x.value)), x -> x.value IS NOT NULL)""")


def _block_totals(parts: str) -> Column:
    return F.expr(f"""
        transform(sequence(0, CAST((size({parts}) - 1) DIV {_BLOCK} AS INT)), c ->
            aggregate(slice({parts}, c * {_BLOCK} + 1, {_BLOCK}), 0, (a, y) -> a + y.step))""")


def _before(totals: str) -> Column:
    return F.expr(f"transform({totals}, (t, b) -> aggregate(slice({totals}, 1, b), 0, (a, y) -> a + y))")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-sum test."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))  # noqa: E731  at most 255 however many zeros it begins with
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substring(part(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return luhn(F.regexp_replace(value, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def entries(gazetteer: DataFrame | None = None) -> dict[str, list[str]]:
    """The entries of each kind, in lower case, of a table (kind, entry); of GAZETTEER where none is given.

    Kinds that no pattern has and null entries are left out; more than ENTRIES
    rows are refused.
    """
    if gazetteer is None:
        rows = GAZETTEER
    else:
        table = gazetteer.where("entry IS NOT NULL").where(F.col("kind").isin(*LOOSE)).select("kind", F.lower("entry").alias("entry")).distinct()
        rows = [(r["kind"], r["entry"]) for r in table.limit(ENTRIES + 1).collect()]
        if len(rows) > ENTRIES:
            raise ValueError(f"a gazetteer may have at most {ENTRIES} entries")
    return {kind: sorted({w for k, w in rows if k == kind}) for kind in LOOSE}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, base, loose): the base spans and the candidates of each row, located and described."""
    known = entries() if known is None else known
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    hints = {
        "email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.contains("+"),
    } | {k: text.rlike(v) for k, v in HINT.items()}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE} | LOOSE
    frame = frame.withColumns({f"p_{k}": _spans(text, patterns[k], hints[k]) for k in KINDS})
    frame = frame.withColumns({f"t_{k}": F.when(F.col(f"p_{k}").isNotNull(), _block_totals(f"p_{k}")) for k in KINDS})
    frame = frame.withColumns({f"s_{k}": _before(f"t_{k}") for k in KINDS})
    none = "CAST(array() AS array<struct<start:int,ord:int,kind:string,value:string>>)"
    frame = frame.select("id", "text", *[F.coalesce(_located(f"p_{k}", f"s_{k}", k), F.expr(none)).alias(f"f_{k}") for k in KINDS])
    valid = lambda kind: F.filter(F.col(f"f_{kind}"), lambda x: _valid(kind, x["value"]))
    base = F.concat(*[valid(k) for k in BASE_KINDS])
    ends = lambda x: F.struct(x["start"], x["ord"], (x["start"] + F.length(x["value"])).alias("end"), x["kind"])
    frame = frame.withColumn("base", F.array_sort(F.transform(base, ends)))

    def describe(x: Column) -> Column:
        value, kind = x["value"], x["kind"]
        left = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        right = F.substring(text, x["start"] + F.length(value) + 1, F.lit(2))
        bit = lambda cond, i: F.when(cond, 1 << i).otherwise(0)
        # the gazetteer is asked for the two words before a candidate and for its own; of a credential for the first of them
        words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))
        own = F.when(kind == "secret", F.slice(words(value), 1, 1)).otherwise(words(value))
        asked = F.concat(F.slice(F.reverse(words(left)), 1, 2), own)
        cue = F.lit(False)
        for k, names in known.items():
            cue = F.when(kind == k, F.arrays_overlap(asked, F.array(*map(F.lit, names)).cast("array<string>"))).otherwise(cue)
        assigned, quoted = left.rlike(r"[=:]\s*[\"']?$"), left.rlike(r"[\"'(<]$") & right.rlike(r"^[\"')>]")
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        strict = (
            F.when(kind == "secret", value.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|AKIA|xox)[A-Za-z0-9_-]+)$"))
            .when(kind == "local_phone", value.rlike(r"^\([2-9][0-9]{2}\) ?[2-9]|^([2-9][0-9]{2})[-.][2-9][0-9]{2}[-.]"))
            .when(kind == "spelled_email", value.rlike(r"(?i)[\[(\x20]at[\])\x20].*[\[(\x20]dot[\])\x20]"))
            .otherwise(value.rlike(r"^\S+ [A-Z][a-z]{2,}"))
        )
        mixed = F.when(kind == "secret", (digits * 5 >= F.length(value)) & ~value.contains("-")).otherwise(~value.rlike(r"(.)\1{3}"))
        # 2 = yes, 0 = no, 1 = abstains
        votes = [
            F.when(strict, 2).otherwise(0),
            F.when(cue, 2).otherwise(1),
            F.when(assigned | quoted, 2).when(kind == "secret", 0).otherwise(1),
            F.when(mixed, 2).otherwise(0),
            F.when(right.rlike(r"^[\s\"').,;]|^$"), 2).otherwise(0),
        ]
        vote = sum((v * 3**i for i, v in enumerate(votes)), F.lit(0))
        bits = (
            bit(F.length(value) >= 32, 0) + bit(value.rlike("[A-Z]"), 1) + bit(value.rlike("[a-z]"), 2) + bit(digits * 3 >= F.length(value), 3)
            + bit(cue, 4) + bit(assigned, 5) + bit(quoted, 6) + bit(value.rlike(r"[-_.\x20]"), 7)
        )
        return F.struct(x["start"], x["ord"], (x["start"] + F.length(value)).alias("end"), kind.alias("kind"), vote.alias("vote"), bits.alias("bits"))

    loose = F.concat(*[F.col(f"f_{k}") for k in LOOSE])
    apart = F.filter(loose, lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["start"] + F.length(x["value"])) & (x["start"] < b["end"])))
    return frame.select("id", "base", F.transform(apart, describe).alias("loose"))


VOTERS, BITS = 5, 8


def reliabilities(patterns: list[tuple[str, int, int]], rounds: int = 50) -> dict[tuple[str, int], float]:
    """EM over (kind, vote pattern, count): the posterior of each (kind, vote pattern).

    Every labeler has, for true and false candidates, its own chances of yes,
    no and silence; labelers are independent given the truth.  Estimates start
    at "better than chance" and are smoothed by one virtual vote each.
    """
    out: dict[tuple[str, int], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [([v // 3**i % 3 for i in range(VOTERS)], v, n) for k, v, n in patterns if k == kind]
        prior, table = 0.5, [[[0.3, 0.2, 0.5] if y == 0 else [0.1, 0.2, 0.7] for y in (0, 1)] for _ in range(VOTERS)]
        table = [[[0.6, 0.2, 0.2], t[1]] for t in table]
        post: list[float] = []
        for _ in range(rounds):
            post = []
            for votes, _, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(table[i][1][v] / table[i][0][v]) for i, v in enumerate(votes))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            total = sum(n for _, _, n in rows)
            true = sum(p * n for p, (_, _, n) in zip(post, rows, strict=True))
            prior = (true + 1) / (total + 2)
            for i in range(VOTERS):
                start = ([0.6, 0.2, 0.2], [0.1, 0.2, 0.7])
                sums = [[2 * x for x in start[y]] for y in (0, 1)]
                for p, (votes, _, n) in zip(post, rows, strict=True):
                    sums[1][votes[i]] += p * n
                    sums[0][votes[i]] += (1 - p) * n
                table[i] = [[x / sum(s) for x in s] for s in sums]
        out |= {(kind, v): p for p, (_, v, _) in zip(post, rows, strict=True)}
    return out


def train_classifier(rows: list[tuple[str, int, float, int]], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, list[float]]:
    """Logistic weights for each kind (bias, then one for each bit) from (kind, bits, posterior, count)."""
    out = {}
    for kind in sorted({r[0] for r in rows}):
        data = [([1.0, *(float(b >> i & 1) for i in range(BITS))], p, n) for k, b, p, n in rows if k == kind]
        total, w = sum(n for _, _, n in data), [0.0] * (BITS + 1)
        for _ in range(steps):
            grad = [-ridge * x for x in w]
            for x, p, n in data:
                q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for i, a in enumerate(x):
                    grad[i] += (p - q) * n / total * a
            w = [a + rate * 4 * g for a, g in zip(w, grad, strict=True)]
        out[kind] = w
    return out


def _score(x: Column, weights: dict[str, list[float]]) -> Column:
    score = F.lit(-1.0)
    for kind, w in weights.items():
        linear = sum((F.lit(w[i + 1]) * F.shiftright(x["bits"], i).bitwiseAND(F.lit(1)) for i in range(BITS)), F.lit(w[0]))
        score = F.when(x["kind"] == kind, linear).otherwise(score)
    return score


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteer: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id, counts of base spans, base_sha256, spans, n_added.

    gazetteer: a table (kind, entry) of known words, GAZETTEER by default.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.cut(find(docs, id_col, text_col, entries(gazetteer)))  # ids and spans only: small beside the texts
    each = found.select(F.explode("loose").alias("x")).select("x.kind", "x.vote", "x.bits")
    counted = [(r["kind"], r["vote"], r["bits"], r["n"]) for r in each.groupBy("kind", "vote", "bits").agg(F.count("*").alias("n")).orderBy("kind", "vote", "bits").collect()]
    patterns: dict[tuple[str, int], int] = {}
    for kind, vote, _, n in counted:  # at most 4 x 3^5 x 2^8 rows
        patterns[kind, vote] = patterns.get((kind, vote), 0) + n
    posterior = reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    weights = train_classifier([(k, b, posterior[k, v], n) for k, v, b, n in counted])

    added = F.transform(
        F.filter(F.col("loose"), lambda x: _score(x, weights) > 0),
        lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"]),
    )
    count = lambda kind: F.size(F.filter(F.col("base"), lambda x: x["kind"] == kind)).cast("long")
    counts = {f"n_{k}": count(k) for k in BASE_KINDS}
    return found.withColumn("added", added).select(
        F.col("id").alias(id_col),
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(read_table(spark, sf_dir, "documents"))
