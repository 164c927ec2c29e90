"""Operator 7: information-theoretic sanitisation, in DataFrame operations only.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers by pattern and
check.  Their values are the protected entities.  A term near an entity may still give it
away after the span is masked.  How strongly is estimated from the corpus: with document
frequencies df over all N documents and c, the number of documents in which the term
stands within CONTEXT characters of the entity,

    PMI(term, entity) = log(c * N / (df(term) * df(entity))),   IC(entity) = log(N / df(entity)).

A term whose PMI reaches DISCLOSURE of the entity's IC in at least SUPPORT documents
discloses it, and is a span of kind ``term`` wherever it stands in that context.
``sanitise`` replaces base spans by their kind and generalises terms to ``[TERM]``; spans that
overlap are masked as one.

The patterns are written so that each text position is looked at a bounded number of
times: runs are entered at their first character only and quantifiers are possessive,
which changes no match.

Defined results: null text is empty and has no spans; repeated rows count as often as
they occur and get the same spans; null ids are rows like others; an empty table gives no rows;
extra columns are ignored by ``find_spans`` and kept by ``sanitise``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialise, measured_broadcast, unused

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth finding all its matches.
GATES = PATTERNS | {"card": r"[0-9](?:[ -]?[0-9]){11}"}
IP_CHECK = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
LEAST_TERM = 3
WORD = r"[\p{L}\p{M}\p{N}_]{" + str(LEAST_TERM) + ",}"
WORD_CHARS = r"[\p{L}\p{M}\p{N}_]+"
#: Characters looked at on either side of an entity.
CONTEXT = 80
SUPPORT = 3
DISCLOSURE = 0.9
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def matches(text: Column, pattern: str, rank: int) -> Column:
    """All matches with their places in code points: gaps between matches and matches in turn."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(span: Column) -> Column:
    return F.regexp_replace(span["value"], "[^0-9]", "")


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s["value"].rlike(IP_CHECK),
    "card": lambda s: F.length(_digits(s)).between(12, 19) & F.call_function("luhn_check", _digits(s)),
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}


def of_rank(rank: int) -> Callable[[Column], Column]:
    """Whether a span is of the kind KINDS[rank]."""
    return lambda s: s["rank"] == rank


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and base: all valid base spans by start, then kind."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gated = given.select("*", *[F.col("text").rlike(p).alias(f"has_{k}") for k, p in GATES.items()])
    none = F.array().cast(SPAN)
    spans = []
    for rank, kind in enumerate(KINDS[:4]):
        found = matches(F.col("text"), PATTERNS[kind], rank)
        spans.append(F.when(F.col(f"has_{kind}"), F.filter(found, CHECKS[kind])).otherwise(none))
    any_kind = F.lit(False)
    for kind in GATES:
        any_kind = any_kind | F.col(f"has_{kind}")
    return gated.select("doc_id", "text", F.when(any_kind, F.array_sort(F.concat(*spans))).otherwise(none).alias("base"))


def _near(text: Column, span: Column, base: Column) -> Column:
    """Words within CONTEXT characters of a span that touch no base span: entity, term, start, end."""
    left_from = F.greatest(span["start"] - CONTEXT, F.lit(0))
    left = F.substring(text, left_from + 1, span["start"] - left_from)
    right = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    # A word that the window cuts is left out; so is one that adjoins the span.
    left_cut = F.when(left_from > 0, F.regexp_replace(left, "^" + WORD_CHARS, "")).otherwise(left)
    left_at = left_from + F.length(left) - F.length(left_cut)
    right_cut = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, WORD_CHARS + "$", "")).otherwise(right)
    entity = F.lower(span["value"])

    def placed(found: Column, at: Column) -> Column:
        return F.transform(found, lambda w: F.struct(entity.alias("entity"), F.lower(w["value"]).alias("term"), (w["start"] + at).alias("start"), (w["end"] + at).alias("end")))

    words = F.concat(placed(matches(left_cut, WORD, 4), left_at), placed(matches(right_cut, WORD, 4), span["end"]))
    return F.filter(words, lambda w: ~F.exists(base, lambda s: (s["start"] <= w["end"]) & (w["start"] <= s["end"])))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Rows doc_id, key_a, key_b (hashes of the row's id and text), base, terms."""
    base = base_spans(docs, id_col, text_col)
    near = F.flatten(F.transform("base", lambda s: _near(F.col("text"), s, F.col("base"))))
    empty = F.array().cast("array<struct<entity:string,term:string,start:int,end:int>>")
    keyed = base.select("doc_id", F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id").alias("key_b"), "base", F.when(F.size("base") > 0, near).otherwise(empty).alias("near"))
    found = materialise(keyed, "pii-spans")

    # Every row counts a pair, an entity or a term once; so counts pre-aggregate where the rows are.
    paired = F.array_distinct(F.transform("near", lambda w: F.struct(w["entity"].alias("entity"), w["term"].alias("term"))))
    together = found.where(F.size("near") > 0).select(F.explode(paired).alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("both"))
    pairs = materialise(together.where(F.col("both") >= support), "pii-pairs")
    if pairs.isEmpty():
        return found.select("doc_id", "key_a", "key_b", "base", F.array().cast(SPAN).alias("terms"))
    total = found.count()
    entities = found.select(F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    entity_df = entities.groupBy("entity").agg(F.count("*").alias("entity_df"))
    # Document frequencies over the words of all documents: counted where the rows are, so that what is
    # joined with the terms in question is one row for each word of the vocabulary, not for each occurrence.
    terms = materialise(pairs.select("term").distinct(), "pii-terms")
    each = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}\p{M}\p{N}_]+"))).alias("term")).where(F.length("term") >= LEAST_TERM)
    term_df = each.groupBy("term").agg(F.count("*").alias("term_df")).join(measured_broadcast(terms), "term")
    n = F.lit(float(total))
    scored = pairs.join(entity_df, "entity").join(term_df, "term")
    ic = F.log(n / F.col("entity_df"))
    pmi = F.log(F.col("both") * n / (F.col("term_df").cast("double") * F.col("entity_df")))
    told = materialise(scored.where((ic > 0) & (pmi >= disclosure * ic)).select("entity", "term"), "pii-told")
    words = found.where(F.size("near") > 0).select("key_a", "key_b", F.explode("near").alias("w")).select("key_a", "key_b", "w.*")
    hits = words.join(measured_broadcast(told), ["entity", "term"]).select("key_a", "key_b", "start", "end", "term").distinct()
    per_row = hits.groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(4).alias("rank"), "end", F.col("term").alias("value")))).alias("terms"))
    out = found.join(per_row, ["key_a", "key_b"], "left")
    return out.select("doc_id", "key_a", "key_b", "base", F.coalesce("terms", F.array()).cast(SPAN).alias("terms"))


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced: base spans by [KIND], terms by [TERM].

    Spans that overlap are masked as one, from the first start to the last end, by the kinds
    of those that reach beyond the ones before: no character of any span stays.
    """
    mark_a, mark_b, spans_at, other_a, other_b = unused(docs.columns, "key_a", "key_b", "spans", "other_a", "other_b")
    found = find_spans(docs, id_col, text_col).select(F.col("key_a").alias(other_a), F.col("key_b").alias(other_b), F.array_sort(F.concat("base", "terms")).alias(spans_at)).dropDuplicates([other_a, other_b])
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select("*", F.xxhash64(F.col(id_col).cast("long"), text).alias(mark_a), F.xxhash64(text, F.col(id_col).cast("long")).alias(mark_b))
    joined = keyed.join(found, (F.col(mark_a) == F.col(other_a)) & (F.col(mark_b) == F.col(other_b)), "left")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        piece = F.concat(acc["out"], gap, F.get(kinds, s["rank"]))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    whole = F.aggregate(spans_at, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return joined.select(*[F.when(F.size(spans_at) > 0, whole).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
