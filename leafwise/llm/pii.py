"""Personal data by weak supervision, in built-in SQL functions only.

Patterns yield candidate spans with their places in code points (split gives the gaps between matches, so their lengths
give the starts). Each candidate is judged by three labelers that vote or abstain: the shape of the value (regex with
checks), a gazetteer of well-known and reserved values, and the words around it. Votes are counted by kind and pattern,
at most 1,728 rows whatever the input; expectation-maximisation on these estimates how reliable each labeler
is, and its posteriors are the soft labels of a logistic span classifier over kind, votes and length, trained on the
same counts. Its weights go back as a Column expression. Spans of the base kinds always stay; the method adds spans of
further kinds that the classifier accepts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leafwise.llm.common import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "handle", "token")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms find the same matches as the plain ones, in linear time. A match begins where a run does, or where
#: the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s{0,4}[=:]\s{0,4}[\"']?[A-Za-z0-9_/+=.-]{8,}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z][A-Za-z0-9_]{2,}+(?![@-]|\.[A-Za-z0-9_])",
    "token": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: A text in which this is not found has no match; a cheap search saves the others.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[=:]", "iban": "[A-Z]{2}[0-9]", "handle": "@[A-Za-z]", "token": "[A-Za-z0-9_-]{20}"}
SPANS = "array<struct<kind:string,start:int,end:int,shape:int,gazetteer:int,context:int,size:int>>"

#: Matches whose places are summed up before they join those before: an array grows by copies, so a text of many
#: matches would else take time with their square.
BLOCK = 256

#: Hosts of personal mail, reserved and placeholder values, prefixes that issuers give their access tokens,
#: countries that issue account numbers.
MAIL_HOSTS = ("gmail", "googlemail", "yahoo", "ymail", "hotmail", "outlook", "live", "msn", "aol", "icloud", "proton", "protonmail", "gmx", "web", "mail", "yandex", "zoho", "fastmail", "orange", "laposte", "t-online", "example")
RESERVED = ("127.0.0.1", "0.0.0.0", "255.255.255.255", "changeme", "password", "xxxxxxxx", "noreply", "no-reply", "todo", "none", "your_", "your-", "insert", "placeholder", "redacted", "********", "localhost", ".invalid", ".test")
TOKEN_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "rk_live_", "AIza", "ya29", "eyJ", "npm_", "pypi-", "hf_", "SG")
IBAN_COUNTRIES = ("AD", "AE", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IL", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SA", "SE", "SI", "SK", "SM", "TR", "UA")
CONTEXT = {
    "email": "e-?mail|mail|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|login|from|connect",
    "card": "card|visa|master|credit|karte|carte|tarjeta|pay|account",
    "phone": "phone|tel|call|mobile|fax|anruf|appel|llam",
    "secret": "password|passwd|pwd|secret|token|key|login|credential",
    "iban": "iban|bank|account|konto|compte|cuenta|bic",
    "handle": "follow|twitter|insta|user|handle|account",
    "token": "token|secret|key|auth|bearer|credential|password|login",
}
#: Words that tell that what follows names a thing and opens nothing.
CONTEXT_AGAINST = {"token": "sha-?[0-9]*|md5|checksum|commit|hash|digest|uuid|guid|etag|revision|build|version|file|path|url|https?", "iban": "serial|part|model|isbn|order", "handle": "import|decorator|param|return|override"}
CONTEXT_CHARS = 40
BELIEF = 0.02


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Luhn's test: from the right, every second digit is doubled and its digits added."""
    reverse = F.reverse(_digits(value))
    digits = F.transform(F.split(reverse, ""), lambda d, i: F.when(d == "", F.lit(0)).otherwise(F.when(i % 2 == 1, (d.cast("int") * 2) - F.when(d.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d.cast("int"))))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10 == 0


def _parts_at_most_255(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) < 4) & (p.cast("int") <= 255))


def valid(kind: str, value: Column) -> Column:
    """Whether a match of ``kind`` counts."""
    n = F.length(_digits(value))
    if kind == "ip":
        return _parts_at_most_255(value)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "token":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """The valid matches of one kind, with the votes of the three labelers and a size class.

    The context is the end of the gap before the match, so that it costs no search through the text."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pieces = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.struct(F.length(g).alias("size"), F.substring(g, -CONTEXT_CHARS, CONTEXT_CHARS).alias("end")))
    both = F.arrays_zip(pieces.alias("g"), found.alias("v"))
    none = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["g"]["size"]
        end = start + F.coalesce(F.length(x["v"]), F.lit(0))
        votes = (shape_vote(F.lit(kind), x["v"]).alias("shape"), gazetteer_vote(F.lit(kind), x["v"]).alias("gazetteer"), context_vote(F.lit(kind), F.lower(x["g"]["end"])).alias("context"))
        size = F.least(F.floor(F.log2(F.length(x["v"]).cast("double"))).cast("int"), F.lit(7))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), *votes, size.alias("size"))
        out = F.when(x["v"].isNotNull() & valid(kind, x["v"]), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def block(state: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(both, k * BLOCK + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(state["out"], done["out"]).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int"))
    spans = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda x: x["out"])
    return F.when(text.isNotNull() & text.rlike(NEEDS[kind]), spans).otherwise(none)


def candidates(text: Column) -> Column:
    """All kinds' matches with their votes."""
    return F.concat(*[matches(text, k) for k in KINDS])


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, vote in of.items():
        out = F.when(kind == k, vote).otherwise(out)
    return out


def _vote(good: Column, bad: Column | None = None) -> Column:
    return F.when(good, 1).when(~good if bad is None else bad, -1).otherwise(0)


def shape_vote(kind: Column, value: Column) -> Column:
    """The value's own form: 1 as such data looks, -1 as it does not, 0 abstains."""
    secret = F.regexp_extract(value, r"[=:]\s*[\"']?(.*)$", 1)
    return _by_kind(
        kind,
        {
            "email": _vote(value.rlike(r"\.[A-Za-z]{2,24}$")),
            "ip": _vote(~value.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")),
            "card": _vote(value.rlike("^[3-6]")),
            "phone": _vote(value.rlike(r"[ ().-]"), F.lit(False)),
            "secret": _vote(secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & (F.length(secret) >= 10), ~secret.rlike("[0-9]")),
            "iban": _vote(F.length(F.regexp_replace(value, " ", "")) >= 18, F.lit(False)),
            "token": _vote(value.rlike("[A-Z]") & value.rlike("[a-z]"), value.rlike("^[0-9a-f-]*$|^[a-z]+([_-][a-z0-9]+)+$")),
        },
    )


def gazetteer_vote(kind: Column, value: Column) -> Column:
    """Lists of well-known and of reserved values."""
    low = F.lower(F.when(kind == "secret", F.regexp_extract(value, r"[=:]\s*[\"']?(.*)$", 1)).otherwise(value))  # of a secret, what its name is given
    known = low.rlike("@(?:[a-z0-9-]+\\.)*(?:" + "|".join(MAIL_HOSTS) + ")\\.") & (kind == "email")
    reserved = F.lit(False)
    for word in RESERVED:
        reserved = reserved | F.contains(low, F.lit(word))
    issued = _vote(value.rlike("^(?:" + "|".join(TOKEN_PREFIXES) + ")"), F.lit(False))
    country = _vote(value.rlike("^(?:" + "|".join(IBAN_COUNTRIES) + ")"))
    return F.when(kind == "iban", country).when(reserved & ~known, -1).when(known, 1).when(kind == "token", issued).otherwise(0)


def context_vote(kind: Column, before: Column) -> Column:
    """The words shortly before the span; a secret names itself."""
    against = {k: F.when(before.rlike(rf"\b(?:{v})\W*$"), -1).otherwise(0) for k, v in CONTEXT_AGAINST.items()}
    return _by_kind(kind, {k: F.when(before.rlike(v), 1).otherwise(against.get(k, F.lit(0))) for k, v in CONTEXT.items()} | {"secret": F.lit(1)})


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights: a bias for each kind, one weight for each labeler's vote and one for the size class."""

    bias: dict[str, float]
    shape: float
    gazetteer: float
    context: float
    size: float

    def score(self, span: Column) -> Column:
        x = _by_kind(span["kind"], {k: F.lit(v) for k, v in self.bias.items()}) + span["shape"] * self.shape + span["gazetteer"] * self.gazetteer
        return 1 / (1 + F.exp(-(x + span["context"] * self.context + span["size"] * self.size)))

    def accepts(self, span: Column) -> Column:
        return span["kind"].isin(*BASE) | (self.score(span) >= 0.5)


def reliabilities(counts: list[tuple], rounds: int = 60) -> list[float]:
    """Posterior that each row of (kind, shape, gazetteer, context, size, n) is personal data, by
    expectation-maximisation: each labeler has a table of votes by class, each kind a prior. Both start from the belief,
    weighing ``BELIEF`` of the data, that a labeler is rather right than wrong and a candidate rather real than not: else
    the classes could change sides where the votes hardly differ."""
    total = sum(c[5] for c in counts)
    of = {k: sum(c[5] for c in counts if c[0] == k) for k in {c[0] for c in counts}}
    post = [0.9 if sum(c[1:4]) > 0 else 0.6 if sum(c[1:4]) == 0 else 0.15 for c in counts]
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        tables = [{(v, y): (1 + BELIEF * total) * (1.0 + (2.0 if v == (1 if y else -1) else 0.0)) / 5 for v in (-1, 0, 1) for y in (0, 1)} for _ in range(3)]
        for c, p in zip(counts, post, strict=True):
            both = prior.setdefault(c[0], [1 + BELIEF * of[c[0]], 2 + 2 * BELIEF * of[c[0]]])
            for y, w in ((0, c[5] * (1 - p)), (1, c[5] * p)):
                both[y] += w
                for j in range(3):
                    tables[j][c[1 + j], y] += w
        totals = [[sum(t[v, y] for v in (-1, 0, 1)) for y in (0, 1)] for t in tables]
        new = []
        for c in counts:
            log = [math.log(prior[c[0]][y]) + sum(math.log(tables[j][c[1 + j], y] / totals[j][y]) for j in range(3)) for y in (0, 1)]
            new.append(_sigmoid(log[1] - log[0]))
        moved = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0)
        post = new
        if moved < 1e-8:
            break
    return post


def train(counts: list[tuple], rounds: int = 300, rate: float = 0.5) -> SpanClassifier:
    """The span classifier, fitted by gradient descent to the soft labels of all patterns, weighted by their counts."""
    post = reliabilities(counts)
    bias, w = dict.fromkeys(KINDS, 0.0), [1.0, 1.0, 1.0, 0.0]
    total = float(sum(c[5] for c in counts)) or 1.0
    of = {k: float(sum(c[5] for c in counts if c[0] == k)) or 1.0 for k in KINDS}
    for _ in range(rounds):
        gb, gw = dict.fromkeys(KINDS, 0.0), [0.001 * x for x in w]
        for c, p in zip(counts, post, strict=True):
            x = (c[1], c[2], c[3], (c[4] - 4) / 3)
            e = _sigmoid(bias[c[0]] + sum(a * b for a, b in zip(w, x, strict=True))) - p
            gb[c[0]] += e * c[5] / of[c[0]]
            for j in range(4):
                gw[j] += e * x[j] * c[5] / total
        bias = {k: v - rate * gb[k] for k, v in bias.items()}
        w = [a - rate * b for a, b in zip(w, gw, strict=True)]
    return SpanClassifier({k: v - w[3] * 4 / 3 for k, v in bias.items()}, w[0], w[1], w[2], w[3] / 3)


def fit(spans: DataFrame) -> SpanClassifier:
    """A classifier from a table with a ``spans`` column of candidates; only counts of vote patterns are gathered."""
    x = spans.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.shape", "x.gazetteer", "x.context", "x.size").count()
    return train(sorted(tuple(r) for r in x.collect()))  # at most 8 kinds * 27 votes * 8 size classes


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    return F.array_sort(F.transform(spans, order))


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, base_sha256, spans as text, and ``found`` (array of kind, start, end).

    A null or empty text has no spans. Spans stay in their row's array, so repeated rows and null ids need no care; an
    empty table gives an empty result. The texts are read once; a table of candidate spans is kept meanwhile."""
    held = stored(df.select(df[id_col].alias("doc_id"), candidates(df[text_col]).alias("spans")))
    model = fit(held)
    marked = held.select("doc_id", _ordered(F.filter("spans", lambda x: x["kind"].isin(*BASE))).alias("base"), _ordered(F.filter("spans", model.accepts)).alias("kept"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    found = F.transform("kept", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return marked.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("kept")).alias("spans"), found.alias("found"))


#: Code points of a text that are cut at once when it is redacted.
PIECE = 4096


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _disjoint(spans: Column) -> Column:
    """Ordered spans without overlaps: one that begins in another lengthens it."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(state: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        last = state["last"]
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        fresh = last.isNull() | (x["start"] >= last["end"])
        out = F.when(last.isNotNull() & fresh, F.concat(state["out"], F.array(last))).otherwise(state["out"])
        return F.struct(F.when(fresh, own).otherwise(longer).alias("last"), out.alias("out"))

    def block(state: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(spans, k * BLOCK + 1, F.lit(BLOCK)), F.struct(state["last"].alias("last"), none.alias("out")), step)
        return F.struct(done["last"].alias("last"), F.concat(state["out"], done["out"]).alias("out"))

    begin = F.struct(F.lit(None).cast("struct<start:int,end:int,kind:string>").alias("last"), none.alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    return F.aggregate(blocks, begin, block, lambda x: F.concat(x["out"], F.array(x["last"])))


def _cut(text: Column, spans: Column) -> Column:
    """``text`` with disjoint ``spans`` replaced. It is cut piece by piece, as a place in a long text costs a walk to it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def one(piece: Column, k: Column) -> Column:
        begin = k * PIECE
        after = lambda own, j: F.greatest(begin, F.coalesce(F.get(own, j - 1)["end"], begin))
        name = lambda x: F.when(x["start"] >= begin, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))

        def told(own: Column) -> Column:
            parts = F.transform(own, lambda x, j: F.concat(F.substring(piece, after(own, j) - begin + 1, F.greatest(F.lit(0), x["start"] - after(own, j))), name(x)))
            return F.concat(F.array_join(parts, ""), F.substring(piece, after(own, F.size(own)) - begin + 1, F.lit(PIECE)))

        return _let(F.filter(spans, lambda x: (x["end"] > begin) & (x["start"] < begin + PIECE)), told)

    return F.array_join(F.transform(pieces, one), "")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each span of personal data in the text replaced by its kind in brackets; overlapping spans become
    one, of the first's kind. Null texts stay null. Candidates are found once and stored beside the rows."""
    held = stored(df.withColumn(spans := _fresh(df, "spans"), candidates(F.col(text_col))))
    model = fit(held.select(F.col(spans).alias("spans")))
    text = F.col(text_col)
    kept = _ordered(F.filter(spans, model.accepts))
    redacted = _let(kept, lambda k: F.when(F.size(k) > 0, _let(_disjoint(k), lambda d: _cut(text, d))).otherwise(text))
    return held.select(*[redacted.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in df.columns])


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
