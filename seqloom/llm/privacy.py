"""Information-theoretic sanitisation: what identifies a person, and the words that give it away.

Base spans: email, ip, card and phone by pattern and check (leftmost, non-overlapping per kind;
failing matches drop out without retry). Their values are the protected entities.

A word ``t`` reveals an entity ``e`` as far as the corpus says so: with documents as contexts,
``PMI(e, t) = log(p(e | t) / p(e))``, of which ``IC(e) = -log p(e)`` is the most there can be. Where
``PMI >= GENERALISE * IC`` the word is a ``term`` span in every document that holds it, with an
entity or without, and is generalised to its first letter; from ``REMOVE`` on it is removed.

* Evidence is what goes beyond one co-occurrence. Any rare word stands beside the address of its
  document, so the text that brings a pair up says nothing: of the other texts with the word,
  those with the entity are counted, and ``p(e | t)`` is the lower end of the Wilson interval of
  that share. A word of one text has no other texts and reveals nothing.
* Most entities stand in one text. They are protected by the group they belong to as well: the
  domain of an address, the first three parts of an ip, the first digits of a phone or card. A group
  is held to the same rule as an entity.
* Near copies are one text: texts that agree in one of ``BANDS`` sketches of ``ROWS`` minima over
  shingles of four words (most of those with a similarity of 0.8) count once, and so do copies.

All of it is DataFrame and SQL functions. Offsets are code points, end exclusive; they come from
the lengths of the pieces between matches. Null text counts as empty. Repeated rows are scanned
each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import SPACE, cut_lineage, keep_ids, text_of

GENERALISE = 0.8
REMOVE = 0.95
#: Standard deviations below the share that the Wilson interval reaches (95 % to one side).
DEVIATIONS = 1.645
#: Sketches of a text, and minima in each.
BANDS, ROWS = 12, 5
#: Bytes of a list of words that goes to every executor; a longer one is joined by word.
BROADCAST_BYTES = 16 << 20
SHORTEST = 4

# The base patterns, so written that a run of characters is tried once: a match starts where a
# run starts or where the last match ended, and never gives characters back.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions that hold for every text with a valid match of the kind.
NEEDED = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = rf"\p{{L}}{{{SHORTEST},}}+"

#: Matches listed together.
BLOCK = 128

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(text: str, pattern: str, kind: str) -> str:
    """SQL: spans of all matches, offsets from the pieces between them."""
    pieces, found = f"split({text}, {pattern}, -1)", f"regexp_extract_all({text}, {pattern}, 0)"
    # the last piece has no match after it
    pairs = (
        f"filter(zip_with({pieces}, {found}, (p, v) -> named_struct('piece', p, 'value', v)),"
        " x -> x.value IS NOT NULL)"
    )
    step = (
        "named_struct('at', a.at + length(x.piece) + length(x.value), 'spans', concat(a.spans, array("
        f"named_struct('kind', '{kind}', 'start', a.at + length(x.piece),"
        " 'end', a.at + length(x.piece) + length(x.value), 'value', x.value))))"
    )
    empty = f"CAST(array() AS array<{SPAN}>)"
    # in blocks, since each step copies what is listed before it
    block = (
        f"aggregate(block, named_struct('at', b.at, 'spans', {empty}), (a, x) -> {step},"
        " a -> named_struct('at', a.at, 'parts', concat(b.parts, array(a.spans))))"
    )
    blocks = (
        f"transform(array({pairs}), y -> transform(sequence(0, size(y) div {BLOCK}),"
        f" k -> slice(y, k * {BLOCK} + 1, {BLOCK})))[0]"
    )
    start = f"named_struct('at', 0L, 'parts', CAST(array() AS array<array<{SPAN}>>))"
    return f"aggregate({blocks}, {start}, (b, block) -> {block}, b -> flatten(b.parts))"


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE
    WHEN (length({_DIGITS}) - i) % 2 = 0 THEN int(substring({_DIGITS}, i, 1))
    ELSE 2 * int(substring({_DIGITS}, i, 1)) - IF(int(substring({_DIGITS}, i, 1)) > 4, 9, 0)
END) % 10 = 0"""
_PART = "0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
VALID = {
    "email": "true",
    "ip": f"s.value RLIKE {_sql(rf'^{_PART}[.]{_PART}[.]{_PART}[.]{_PART}$')}",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def base_spans(text: str = "text") -> Column:
    """Valid base spans of column ``text``, by kind as listed, then start."""
    kinds = []
    for kind, pattern in PATTERNS.items():
        spans = located(text, _sql(pattern), kind)
        kinds.append(
            f"CASE WHEN {text} RLIKE {_sql(NEEDED[kind])}"
            f" THEN filter({spans}, s -> {VALID[kind]}) ELSE CAST(array() AS array<{SPAN}>) END"
        )
    return F.expr(f"concat({', '.join(kinds)})")


def _masked(text: str) -> str:
    """SQL: ``text`` without what the base patterns match."""
    masked = text
    for kind, pattern in PATTERNS.items():
        masked = f"CASE WHEN {text} RLIKE {_sql(NEEDED[kind])} THEN regexp_replace({masked}, {_sql(pattern)}, ' ') ELSE {masked} END"
    return masked


def words(text: str) -> Column:
    """Different words of column ``text`` outside what the base patterns match."""
    return F.expr(f"array_distinct(regexp_extract_all({_masked(text)}, {_sql(WORD)}, 0))")


def sketches(text: str) -> Column:
    """``BANDS`` numbers; near copies share one of them nearly always, other texts hardly ever."""
    listed = f"regexp_extract_all({_masked(text)}, {_sql(f'[^{SPACE[1:-2]}]++')}, 0)"
    hashed = "transform(sequence(1, greatest(size(w) - 3, 1)), i -> xxhash64(array_join(slice(w, i, 4), ' ')))"
    bands = ", ".join(
        f"xxhash64({band}, {', '.join(f'array_min(transform(h, x -> xxhash64(x, {band * ROWS + k})))' for k in range(ROWS))})"
        for band in range(BANDS)
    )
    return F.expr(f"transform(transform(array({listed}), w -> {hashed}), h -> array({bands}))[0]")


def groups_of(span: str) -> str:
    """SQL: an entity and the group it belongs to."""
    digits = f"regexp_replace({span}.value, '[^0-9]', '')"
    group = f"""CASE {span}.kind WHEN 'email' THEN lower(substring_index({span}.value, '@', -1))
        WHEN 'ip' THEN substring_index({span}.value, '.', 3)
        WHEN 'phone' THEN left({digits}, 6) ELSE left({digits}, 8) END"""
    return f"array(concat({span}.kind, ':', {span}.value), concat({span}.kind, ' of ', {group}))"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, text, row`` of every row."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("spans", base_spans())
    return cut_lineage(
        rows.select("doc_id", "spans", "text", F.monotonically_increasing_id().alias("row"))
    )


def entity_texts(scanned: DataFrame) -> DataFrame:
    """``content, copies, text_id, entities, terms`` of each different text that holds an entity.

    Near copies have one ``text_id``.
    """
    held = scanned.where("size(spans) > 0").select(
        F.xxhash64("text").alias("content"),
        F.expr(f"array_distinct(flatten(transform(spans, s -> {groups_of('s')})))").alias("entities"),
        words("text").alias("terms"),
        sketches("text").alias("sketches"),
    )
    texts = cut_lineage(
        held.groupBy("content").agg(
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("entities", "terms", "sketches")],
        )
    )
    known = texts.select("content", F.col("content").alias("text_id"), F.explode("sketches").alias("sketch"))
    for _ in range(2):  # the least number among those that share a sketch, and among theirs
        least = known.groupBy("sketch").agg(F.min("text_id").alias("least"))
        joined = known.join(least, "sketch").groupBy("content").agg(F.min("least").alias("text_id"))
        joined = cut_lineage(joined)
        known = known.drop("text_id").join(joined, "content")
    return texts.drop("sketches").join(joined, "content")


def lower_share(hits: str, trials: str) -> str:
    """SQL: lower end of the Wilson interval of ``hits / trials``; 0 without trials."""
    z = f"{DEVIATIONS}D"
    share = f"({hits} / CAST({trials} AS DOUBLE))"
    middle = f"({share} + {z} * {z} / (2 * {trials}))"
    spread = f"{z} * sqrt(({share} * (1 - {share}) + {z} * {z} / (4 * {trials})) / {trials})"
    return f"IF({trials} <= 0, 0D, ({middle} - {spread}) / (1 + {z} * {z} / {trials}))"


def disclosures(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``entity, term, share``: pairs whose PMI is at least ``GENERALISE`` of the entity's IC."""
    total = scanned.count()
    texts = cut_lineage(entity_texts(scanned))
    holders = cut_lineage(texts.select("content", "text_id", F.explode("entities").alias("entity")))
    counted = holders.groupBy("entity").agg(F.count_distinct("text_id").alias("n_e")).where("n_e > 1")
    counted = cut_lineage(counted)
    together = (
        holders.drop("text_id").join(counted.select("entity"), "entity", "left_semi")
        .join(texts.select("content", "text_id", "copies", "terms"), "content")
        .select("entity", "text_id", "copies", F.explode("terms").alias("term"))
        .groupBy("entity", "term", "text_id")
        .agg(F.sum("copies").alias("copies"))
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_et"), F.sum("copies").alias("documents"))
        .where("n_et > 1")
    )
    pairs = cut_lineage(together.withColumn("word", F.xxhash64("term")))
    wanted = cut_lineage(pairs.select("word").distinct())
    said = scanned.select(F.explode(F.transform(words_of_all(), lambda w: F.xxhash64(w))).alias("word"))
    counts = keep_ids(said, wanted, "word", wanted.count()).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_t")
    )
    # copies and near copies beside the entity are one text among those that hold the word
    others = "(n_t - documents + n_et - 1)"
    share = f"1 + ln({lower_share('(n_et - 1)', others)}) / ln({float(total)}D / n_e)"
    return (
        pairs.join(cut_lineage(counts), "word")
        .join(counted.where(F.col("n_e") < total), "entity")
        .select("entity", "term", F.expr(f"IF({others} > 0, {share}, 0D)").alias("share"))
        .where(F.col("share") >= GENERALISE)
    )


def words_of_all() -> Column:
    return F.expr(f"array_distinct(regexp_extract_all(coalesce(text, ''), {_sql(WORD)}, 0))")


def term_spans(scanned: DataFrame, revealed: DataFrame) -> DataFrame:
    """``row, terms``: spans of revealing words, with ``share`` of the most they give away.

    A word counts wherever it stands, also in documents that do not hold the entity.
    """
    most = cut_lineage(revealed.groupBy("term").agg(F.max("share").alias("share")))
    told, size = most, most.agg(F.count(F.lit(1)), F.sum(F.octet_length("term") + 16)).first()
    if (size[1] or 0) <= BROADCAST_BYTES:
        told = F.broadcast(most)
    held = (
        scanned.select("row", F.explode(words_of_all()).alias("term"))
        .join(told, "term")
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    )
    # only the row's own revealing words are listed
    apart = "map_contains_key(told, s.value) AND NOT exists(spans, b -> b.start < s.end AND s.start < b.end)"
    item = "named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'value', s.value, 'share', told[s.value])"
    listed = f"transform(filter({located('text', _sql(WORD), 'term')}, s -> {apart}), s -> {item})"
    return scanned.join(held, "row").select("row", F.expr(f"array_sort({listed})").alias("terms"))


def protect(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, terms, text``; ``terms`` is null or empty in documents without any."""
    scanned = scan(docs)
    revealed = cut_lineage(disclosures(docs, scanned))
    terms = cut_lineage(term_spans(scanned, revealed))
    return scanned.join(terms, "row", "left").select("doc_id", "spans", "text", "terms")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans, one row per input row."""
    listed = "concat_ws(',', transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    base = listed.format("spans")
    terms = "transform(coalesce(terms, array()), s -> concat(s.kind, ':', s.start, ':', s.end))"
    counts = [
        F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
        for kind in PATTERNS
    ]
    return protect(docs).select(
        "doc_id",
        *counts,
        F.sha2(F.expr(base), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(spans, s -> concat(s.kind, ':', s.start, ':', s.end)), {terms})").alias("spans"),
        F.expr("CAST(coalesce(size(terms), 0) AS bigint)").alias("n_term"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: base spans as ``[kind]``, words removed or cut to their first letter.

    Only rows with a span come back; every other text stays as it is.
    """
    found = protect(docs).where("size(spans) > 0 OR size(terms) > 0")
    base = "transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'by', concat('[', s.kind, ']')))"
    by = f"IF(s.share >= {REMOVE}, '', concat(substring(s.value, 1, 1), '*'))"
    terms = (
        f"transform(coalesce(terms, array()), s -> named_struct('start', s.start, 'end', s.end, 'by', {by}))"
    )
    # overlapping base spans: the later one starts where the earlier one ended
    step = (
        "named_struct('at', greatest(a.at, e.end), 'out', concat(a.out,"
        " IF(e.start > a.at, substring(text, int(a.at + 1), int(e.start - a.at)), ''),"
        " IF(e.end > a.at, e.by, '')))"
    )
    edits = f"array_sort(concat({base}, {terms}))"
    joined = (
        f"aggregate({edits}, named_struct('at', 0L, 'out', ''), (a, e) -> {step},"
        " a -> concat(a.out, substring(text, int(a.at + 1))))"
    )
    return found.select("doc_id", F.expr(joined).alias("text"))
