"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean query over trigrams of
lower-cased text: an AND of groups, a group an OR of literals, a literal the
AND of its trigrams. The index holds postings (trigram, text key) of the
trigrams that some rule asks for, one for each different text; they are found
in one pass over the distinct words of a text. Postings are
intersected by OR-ing their bits by text key; texts whose bits satisfy a
rule's query are its candidates and are verified with the expression itself.
A rule without mandatory trigrams scans every text.

The text key is a 64-bit hash of the text: two texts with one key can only add
a candidate, never lose one, and copies have one posting. Where texts meet
their flags, the copies of a text are dealt into PARTS parts.
"""

from __future__ import annotations

import re
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alternatives, materialise, own_name


@dataclass(frozen=True)
class Rule:
    """pattern: in syntax that Java and Python share. fold: letters outside of character classes match in either case. group, least: matches whose group is shorter are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


#: Fixed formats of credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, base=True),  # the greedy runs of at least 24
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: A class of more characters, or a product of more strings, is no literal.
MOST_LITERALS = 16
#: Parts into which the copies of one text are dealt.
PARTS = 8
MASK = "[SECRET]"


def _walk(nodes) -> tuple[list[str] | None, list[list[str]]]:
    """Of a parsed expression: all strings it matches, if they are few, and otherwise groups of literals of each of which one must occur."""
    exact: list[str] = [""]
    whole = True
    groups: list[list[str]] = []

    def end():
        nonlocal exact, whole
        groups.append(exact)
        exact, whole = [""], False

    for op, arg in nodes:
        name = str(op)
        own: list[str] | None = None
        inner: list[list[str]] = []
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "IN":
            chars: list[str] = []
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.append(chr(value))
                elif str(kind) == "RANGE" and value[1] - value[0] < MOST_LITERALS:
                    chars += map(chr, range(value[0], value[1] + 1))
                else:
                    chars = []
                    break
            own = chars if 0 < len(chars) <= MOST_LITERALS and str(arg[0][0]) != "NEGATE" else None
        elif name == "SUBPATTERN":
            own, inner = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                own = [s for e, _ in parts for s in e]
            else:
                best = [e if e is not None else max(g, key=lambda v: min(map(len, v)), default=None) for e, g in parts]
                inner = [[s for v in best for s in v]] if all(best) else []
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            e, g = _walk(body)
            if e is not None and most == 1:
                own = e if least else ["", *e]
            elif e is not None and least == most and len(e) == 1:
                own = [e[0] * least]
            elif least:
                inner = g or ([e] if e is not None else [])
        if own is not None and len(exact) * len(own) <= MOST_LITERALS:
            exact = [x + y for x in exact for y in own]
        elif own is not None:
            end()
            exact = own
        else:
            end()
            groups += inner
    if whole:
        return exact, []
    groups.append(exact)
    return None, groups


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """AND over groups, OR in a group, AND over the trigrams of a member; empty if the rule has no mandatory trigram. Trigrams with white space are left out, as postings are made from words."""
    exact, groups = _walk(parser.parse(rule.pattern))
    query = []
    for literals in [exact] if exact is not None else groups:
        parts = [frozenset(g for g in (s.lower()[i : i + 3] for i in range(len(s) - 2)) if not re.search(r"\s", g)) for s in literals]
        if parts and all(parts) and all(g.isascii() for p in parts for g in p):
            query.append(parts)
    return query


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in a text as structs (start, order, end, kind), in code points; positions follow from the lengths of the pieces between matches."""
    pieces, found = F.split(text, rule.java, -1), F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else found
    span = "struct<start:bigint,order:int,end:bigint,kind:string>"
    none = F.array().cast(f"array<{span}>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["found"])
        one = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("order"), stop.cast("long").alias("end"), F.lit(rule.kind).alias("kind")).cast(span))
        return F.struct(stop.cast("long").alias("at"), F.when(F.length(x["held"]) >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("found"), held.alias("held"))
    some = F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(F.rlike(text, F.lit(rule.java)), some).otherwise(none)


def postings(texts: DataFrame, rules=RULES) -> tuple[DataFrame, list[str]]:
    """The index of texts (key, text): rows (gram, key), gram a place in the list that is returned too.

    A text has one row for each different trigram that some rule asks for,
    wherever in it that stands; a null or empty text has none. Repeated texts
    repeat their rows. An empty table, or rules without trigrams, give no rows.
    """
    grams = sorted({g for r in rules for group in trigram_query(r) for part in group for g in part})
    if not grams:
        return texts.select("key", F.lit(0).alias("gram")).limit(0), grams
    words = F.array_join(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")), " ")
    found = F.array_distinct(F.regexp_extract_all(words, F.lit(f"(?=({alternatives(grams)}))"), F.lit(1)))
    places = F.transform(found, lambda g: (F.array_position(F.array(*map(F.lit, grams)), g) - 1).cast("int"))
    return texts.select("key", F.explode(places).alias("gram")), grams


def candidates(index: DataFrame, grams: list[str], rules=RULES) -> DataFrame:
    """key and, for every rule that has a query, whether the key's postings satisfy it; keys that satisfy none are left out.

    Repeated postings count once. An empty index, or rules without queries,
    give no rows.
    """
    at = {g: i for i, g in enumerate(grams)}
    words = -(-len(grams) // 60) or 1
    bits = [F.bit_or(F.expr(f"CASE WHEN gram DIV 60 = {w} THEN shiftleft(1L, CAST(gram % 60 AS INT)) ELSE 0L END")).alias(f"m{w}") for w in range(words)]
    masks = index.groupBy("key").agg(*bits)

    def satisfied(rule: Rule) -> Column:
        every = F.lit(True)
        for group in trigram_query(rule):
            some = F.lit(False)
            for part in group:
                need = [sum(1 << at[g] % 60 for g in part if at[g] // 60 == w) for w in range(words)]
                one = F.lit(True)
                for w, mask in enumerate(need):
                    if mask:
                        one = one & (F.col(f"m{w}").bitwiseAND(F.lit(mask)) == mask)
                some = some | one
            every = every & some
        return every

    asked = [r for r in rules if trigram_query(r)]
    out = masks.select("key", *[satisfied(r).alias(f"is_{r.kind}") for r in asked])
    return out.where(F.array_contains(F.array(*[F.col(f"is_{r.kind}") for r in asked]), True)) if asked else out.limit(0)


def scan(df: DataFrame, *, text: str = "text", rules=RULES, to: str = "spans") -> DataFrame:
    """df with an array of spans (start, order, end, kind) of secrets, by start and then by the rules' order.

    start and end are code points, end exclusive; of one kind spans never
    overlap, of several they may. Null counts as empty, and has no spans. Rows
    that repeat have the same spans each. An empty table gives an empty
    result. A column of df named like `to` is replaced.
    """
    df = df.drop(to)
    key, part, flags = own_name(df, "key"), own_name(df, "part"), own_name(df, "flags")
    body = F.coalesce(F.col(text), F.lit(""))
    index, grams = postings(df.select(F.xxhash64(body).alias("key"), body.alias("text")), rules)
    index = materialise(index.distinct(), "postings")
    chosen = candidates(index, grams, rules)
    chosen = chosen.select(F.col("key").alias(key), F.struct(*[c for c in chosen.columns if c != "key"], F.lit(True).alias("any")).alias(flags))
    chosen = chosen.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    rows = df.withColumn(key, F.xxhash64(body)).withColumn(part, F.monotonically_increasing_id() % PARTS)
    joined = rows.join(chosen, [key, part], "left")
    parts = []
    for order, rule in enumerate(rules):
        some = _spans(body, rule, order)
        if trigram_query(rule):
            some = F.when(F.coalesce(F.col(flags)[f"is_{rule.kind}"], F.lit(False)), some).otherwise(F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>"))
        parts.append(some)
    return joined.select(*df.columns, F.array_sort(F.concat(*parts)).alias(to))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, *, text: str = "text", spans: str = "spans", mask: str = MASK) -> DataFrame:
    """df with every run of overlapping spans in text replaced by mask.

    Rows without spans, or with null for them, keep their text, also a null or
    empty one; spans that touch leave a mask each. Repeated rows are treated
    alike, other columns stay, texts of any length are treated whole, and an
    empty table gives an empty result.
    """
    body = F.col(text)

    def add(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col(spans), start, add, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    return df.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body))
