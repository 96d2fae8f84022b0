"""Apply every rule to every text.

The unrolled plan is one projection over the texts: an array with one
``regexp_extract_all`` per rule, exploded into matches. It needs no shuffle and
no join, reads each text once and keeps every pattern a literal, compiled once.
Packs of more than ``MAX_UNROLLED`` rules take the join plan: an index from gate
words to rules is looked up once per text, and the rules it names are joined by
number from a broadcast table. The texts are read once, whatever the pack's size.

Explodes are the *outer* kind on purpose: an inner one makes the optimizer test
the array's size below the projection, which runs every regex twice.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.functions.dense import places
from textsentry.functions.regex import JAVA_FLAGS
from textsentry.functions.text import (
    before_first,
    byte_position,
    byte_slice,
    contains_any,
    count_newlines,
    running_totals,
    sql_string,
    trim_space,
    with_value,
)
from textsentry.operators.rules import compile_rules, rule_pack, select_rules
from textsentry.schemas import FINDING_COLUMNS
from textsentry.session import broadcast_if_small, materialise
from textsentry.sources.chunks import CHUNK_BYTES, DEFAULT_THRESHOLD_MB, OVERLAP_BYTES, chunk_texts

# Matches of at most this many bytes, blanks at the ends aside, are dropped.
MIN_MATCH_BYTES = 5

# Letters that match an ASCII letter when case is ignored but that lower() does
# not turn into it. Texts holding one skip the keyword gate.
ODD_CASE_LETTERS = ["ſ", "ı", "İ"]

# Set around matches where their own places are asked for; texts that hold it get its neighbour instead.
_SET_OFF, _INSTEAD = "\ufdd0", "\ufdd1"

# Rules per array, and per projection, in the unrolled plan.
_BLOCK = 64
MAX_UNROLLED = 256

# Rule fields a finding needs, and their names on the way there.
_ATTRIBUTES = {
    "group": "group",
    "name": "rule_name",
    "context_left": "__left",
    "context_right": "__right",
    "sensitive": "sensitive",
}


def long_enough(match: Column) -> Column:
    return F.octet_length(trim_space(match)) > MIN_MATCH_BYTES


def prepare(rules: DataFrame, **choice) -> list[dict]:
    """Select, compile and check rules; the result can be scanned with many times."""
    if "pattern" not in rules.columns:
        rules = compile_rules(select_rules(rules, **choice))
    return rule_pack(rules)


def scan(
    texts: DataFrame,
    rules: DataFrame | list[dict],
    id_cols: list[str],
    text_col: str = "text",
    *,
    offset_col: str | None = None,
    line_col: str | None = None,
    own_cols: tuple[str, str] | None = None,
    plan: str = "unrolled",
) -> DataFrame:
    """Findings of ``rules`` in ``texts``: the id columns, then the finding columns.

    ``rules`` is a rules table or what ``rule_pack`` made of one, which saves
    preparing the same pack for every table. A table that is not compiled yet
    goes through ``select_rules`` and ``compile_rules`` first. ``offset_col`` and
    ``line_col`` name the byte offset and first line of each text inside a larger
    one. ``plan`` is ``unrolled`` or ``join``; a pack too large to unroll is joined.

    ``own_cols`` names two columns of byte offsets: only matches that start
    between them are kept, and position, line and context are then those of the
    match itself instead of its first occurrence. It takes the unrolled plan.
    """
    pack = rules if isinstance(rules, list) else prepare(rules)
    exact = own_cols is not None
    if exact:
        texts = texts.withColumn(text_col, F.translate(text_col, _SET_OFF, _INSTEAD))
    keep = list(dict.fromkeys(c for c in (*id_cols, text_col, offset_col, line_col, *(own_cols or ())) if c))
    base = texts.select(*keep)
    if not pack:
        matches = _no_matches(base)
    elif plan not in ("unrolled", "join"):
        raise ValueError(f"unknown plan {plan!r}")
    elif exact:
        matches = _exact(base, pack, text_col)
    elif plan == "unrolled" and len(pack) <= MAX_UNROLLED:
        matches = _unrolled(base, pack, text_col)
    else:
        matches = _joined(base, pack, text_col)
    if own_cols:
        return _own(_placed(matches, text_col, own_cols), id_cols, offset_col, line_col)
    return _locate(matches, id_cols, text_col, offset_col, line_col)


def _no_matches(base: DataFrame) -> DataFrame:
    types = {"__matches": "array<string>", "group": "string", "rule_name": "string"}
    types |= {"__left": "int", "__right": "int", "sensitive": "boolean"}
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in types.items()]
    return base.where("false").select("*", *empty)


def _with_case_columns(base: DataFrame, text_col: str) -> DataFrame:
    return base.withColumns(
        {
            "__lower": F.lower(F.col(text_col)),
            "__odd": contains_any(F.col(text_col), ODD_CASE_LETTERS),
        }
    )


def _gate_sql(words: list[str]) -> str:
    tests = [f"contains(__lower, {sql_string(word)})" for word in words]
    return " OR ".join(["__odd", *tests])


def _extract_sql(rule: dict, text_col: str, exact: bool = False, only: str = "") -> str:
    """The matches of a rule; if ``exact``, the whole text cut at both ends of each, matches at odd places."""
    pattern = sql_string(rule["pattern"])
    tests = [only] if only else []
    found = f"regexp_extract_all(`{text_col}`, {pattern}, 0)"
    if exact:
        found = f"split(regexp_replace(`{text_col}`, {pattern}, '{_SET_OFF}$0{_SET_OFF}'), '{_SET_OFF}')"
    if rule["keyword_gate"]:
        tests.append(f"({_gate_sql(rule['keyword_gate'])})")
    if rule["filter"]:
        tests.append(f"rlike(`{text_col}`, {sql_string(JAVA_FLAGS + rule['filter'])})")
    if exact:  # most rules match few texts, and only those are written anew
        tests.append(f"rlike(`{text_col}`, {pattern})")
    return f"CASE WHEN {' AND '.join(tests)} THEN {found} END" if tests else found


def _unrolled(
    base: DataFrame, pack: list[dict], text_col: str, exact: bool = False, only_col: str | None = None, number: int = 0
) -> DataFrame:
    # One SQL expression for the whole pack: built column by column, a pack
    # costs seconds of driver time.
    listed = [f"array_contains(`{only_col}`, {number + i})" if only_col else "" for i in range(len(pack))]
    per_rule = [_extract_sql(rule, text_col, exact, only) for rule, only in zip(pack, listed, strict=True)]
    blocks = [
        "array(" + ", ".join(per_rule[i : i + _BLOCK]) + ")"
        for i in range(0, len(per_rule), _BLOCK)
    ]
    hits = F.expr(blocks[0] if len(blocks) == 1 else f"concat({', '.join(blocks)})")
    attributes = F.from_json(
        F.lit(json.dumps([{new: rule[old] for old, new in _ATTRIBUTES.items()} for rule in pack])),
        "array<struct<`group`:string,rule_name:string,__left:int,__right:int,sensitive:boolean>>",
    )
    return (
        _with_case_columns(base, text_col)
        .select(*base.columns, hits.alias("__hits"))
        .select(*base.columns, F.posexplode_outer("__hits").alias("__rule", "__matches"))
        .where(F.size("__matches") > int(exact))
        .select(*base.columns, (F.col("__rule") + number).alias("__rule"), "__matches", attributes[F.col("__rule")].alias("__attributes"))
        .select(*base.columns, *(["__rule"] if exact else []), "__matches", "__attributes.*")
    )


def _named_rules(pack: list[dict]) -> Column:
    """The numbers of the rules that may match a text: those without a gate, and those a gate word names."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(pack):
        for word in rule["keyword_gate"] or []:
            index.setdefault(word, []).append(number)
    entries = F.from_json(
        F.lit(json.dumps([{"word": word, "rules": rules} for word, rules in index.items()])),
        "array<struct<word:string,rules:array<int>>>",
    )
    always = [number for number, rule in enumerate(pack) if not rule["keyword_gate"]]
    free = F.from_json(F.lit(json.dumps(always)), "array<int>")
    held = F.filter(entries, lambda e: F.contains(F.col("__lower"), e["word"]))
    named = F.array_distinct(F.concat(free, F.flatten(F.transform(held, lambda e: e["rules"]))))
    return F.when(F.col("__odd"), F.sequence(F.lit(0), F.lit(len(pack) - 1))).otherwise(named)


def _joined(base: DataFrame, pack: list[dict], text_col: str) -> DataFrame:
    spark = base.sparkSession
    rows = [(i, r["pattern"], r["filter"], *(r[field] for field in _ATTRIBUTES)) for i, r in enumerate(pack)]
    schema = (
        "__rule int, __pattern string, __filter string, `group` string, rule_name string, "
        "__left int, __right int, sensitive boolean"
    )
    # The pack is at most MAX_RULES rows.
    table = F.broadcast(spark.createDataFrame(rows, schema))
    text = F.col(text_col)
    sieve = F.col("__filter").isNull() | F.rlike(text, F.concat(F.lit(JAVA_FLAGS), F.col("__filter")))
    # The one-element explode keeps the size test from moving the regex into a filter.
    matches = F.array(F.when(sieve, F.regexp_extract_all(text, F.col("__pattern"), F.lit(0))))
    return (
        _with_case_columns(base, text_col)
        .select(*base.columns, F.explode_outer(_named_rules(pack)).alias("__rule"))
        .join(table, "__rule")
        .select(
            *base.columns,
            F.explode_outer(matches).alias("__matches"),
            "group",
            "rule_name",
            "__left",
            "__right",
            "sensitive",
        )
        .where(F.size("__matches") > 0)
    )


def _placed(matches: DataFrame, text_col: str, own_cols: tuple[str, str], sound: bool = False) -> DataFrame:
    """Add ``__found``, the matches that start in the own bytes, with their own places, and ``__over``.

    Texts come cut at both ends of each match. Places are running totals over the
    pieces, so the cost is linear in the text and its matches. With ``sound`` a rule
    one of whose matches runs over an end of the own bytes is ``__over``, without ``__found``.
    """
    text, cut = F.col(text_col), F.col("__matches")
    first, last = (F.col(c).cast("long") for c in own_cols)
    left, right = F.greatest("__left", F.lit(0)), F.greatest("__right", F.lit(0))
    bare = (F.col("__left") <= 0) & (F.col("__right") <= 0)

    def extent(x: Column) -> Column:
        """Bytes and line ends in one number; a text has fewer than 2**31 of either."""
        return F.octet_length(x) + F.shiftleft(count_newlines(x), 32)

    # Each match, what lies before it and itself: one entry of the totals for both.
    numbers = F.sequence(F.lit(1), F.size(cut) - 1, F.lit(2))
    pairs = F.transform(
        numbers,
        lambda i: F.struct(F.get(cut, i).alias("m"), extent(F.get(cut, i - 1)).alias("gap"), extent(F.get(cut, i)).alias("own")),
    )

    def spots(ps: Column) -> Column:
        # Entries are walked, not looked up by number: a lookup would work out all totals for each.
        totals = running_totals(F.transform(ps, lambda p: p["gap"] + p["own"]))
        return F.zip_with(ps, totals, lambda p, before: spot(p["m"], before + p["gap"]))

    def spot(match: Column, at: Column) -> Column:
        start = at.bitwiseAND(F.lit((1 << 32) - 1))
        end = start + F.octet_length(match)
        return F.struct(match.alias("match"), start.alias("start"), end.alias("end"), F.shiftright(at, 32).alias("lines"))

    def place(m: Column) -> Column:
        around = byte_slice(text, F.greatest(F.lit(0).cast("long"), m["start"] - left), F.least(F.octet_length(text), m["end"] + right))
        return F.struct(m["match"], m["start"], m["lines"], F.when(bare, m["match"]).otherwise(around).alias("context"))

    def own(ms: Column) -> Column:
        return F.transform(F.filter(ms, lambda m: (m["start"] >= first) & (m["start"] < last)), place)

    def step(at: Column, i: Column) -> Column:
        """The end of match ``i`` if the one before ended ``at``; -1 from the first that runs over on."""
        start = at + F.octet_length(F.get(cut, i - 1))
        end = start + F.octet_length(F.get(cut, i))
        over = ((start < first) & (first < end)) | ((start < last) & (last < end))
        return F.when(at < 0, at).when(over, F.lit(-1).cast("long")).otherwise(end)

    # Told before anything is placed, as the matches of such a rule are not wanted.
    over = F.aggregate(numbers, F.lit(0).cast("long"), step) < 0 if sound else F.lit(False)
    held = F.when(over, F.lit(None)).otherwise(with_value(with_value(pairs, spots), own))
    carried = [c for c in matches.columns if c != "__matches"]
    return matches.select(*carried, held.alias("__found")).withColumn("__over", F.col("__found").isNull())


def _own(placed: DataFrame, id_cols: list[str], offset_col: str | None, line_col: str | None) -> DataFrame:
    """Findings of the matches found, with their own places."""
    offset = F.col(offset_col) if offset_col else F.lit(0).cast("long")
    line = F.col(line_col) if line_col else F.lit(1).cast("long")
    return (
        placed.withColumn("__m", F.explode_outer("__found"))
        .where(long_enough(F.col("__m.match")))
        .select(
            *id_cols,
            "group",
            "rule_name",
            "__m.match",
            "__m.context",
            (offset + F.col("__m.start")).cast("long").alias("position"),
            (line + F.col("__m.lines")).alias("line_number"),
            "sensitive",
        )
        .select(*id_cols, *FINDING_COLUMNS)
    )


def scan_large(
    texts: DataFrame,
    rules: DataFrame | list[dict],
    id_cols: list[str],
    text_col: str = "text",
    *,
    threshold_mb: float = DEFAULT_THRESHOLD_MB,
    chunk_bytes: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
    spread_chunks: bool = False,
) -> DataFrame:
    """Findings of the whole texts, each match at its own place, though large texts are scanned in chunks.

    Chunks overlap and are scanned by themselves. Where no match of a rule runs
    over an end of a chunk's own bytes, seen from either side, matching goes on
    there as it would in the whole text. Where one does, what comes behind it
    depends on where it ends, through any number of chunks: such a rule is
    matched again over that whole text, and only there. Matches, and what they
    look at around them, must not reach further than ``overlap``. Texts that
    share their ids are taken together; null ids are ids.
    """
    pack = rules if isinstance(rules, list) else prepare(rules)
    own, key = ("own_from", "own_to"), F.xxhash64(*id_cols)
    plain = texts.select(*id_cols, text_col).withColumn(text_col, F.translate(text_col, _SET_OFF, _INSTEAD))
    pieces = chunk_texts(
        plain, id_cols, text_col, threshold_mb=threshold_mb, chunk_bytes=chunk_bytes, overlap=overlap, spread_chunks=spread_chunks
    )
    base = pieces.select(*id_cols, "start_offset", "start_line", *own, "text")
    if not pack:
        return _own(_placed(_no_matches(base), "text", own), id_cols, "start_offset", "start_line")
    placed = _placed(_exact(base, pack, "text"), "text", own, sound=True).drop("text")
    placed = materialise(placed.withColumn("__key", key), "chunks")
    broken = materialise(placed.where("__over").groupBy("__key").agg(F.array_sort(F.collect_set("__rule")).alias("__only")), "broken")
    broken_rules = broken.select("__key", F.explode("__only").alias("__rule"))
    sound = placed.where(F.size("__found") > 0).join(broken_rules, ["__key", "__rule"], "left_anti")
    again = (
        plain.withColumn("__key", key)
        .join(broadcast_if_small(broken), "__key")
        .drop("__key")
        .withColumns({"own_from": F.lit(0), "own_to": F.octet_length(text_col)})
    )
    whole = _placed(_exact(again, pack, text_col, "__only"), text_col, own)
    return _own(sound, id_cols, "start_offset", "start_line").unionByName(_own(whole, id_cols, None, None))


def _exact(base: DataFrame, pack: list[dict], text_col: str, only_col: str | None = None) -> DataFrame:
    """Texts cut at their matches, by rule (``__rule``); with ``only_col`` only for the rules it lists."""
    blocks = range(0, len(pack), MAX_UNROLLED)
    return reduce(
        DataFrame.unionByName, [_unrolled(base, pack[i : i + MAX_UNROLLED], text_col, True, only_col, i) for i in blocks]
    )


def _locate(
    matches: DataFrame,
    id_cols: list[str],
    text_col: str,
    offset_col: str | None,
    line_col: str | None,
) -> DataFrame:
    """Byte position, line and context, all taken at the first occurrence of the match text."""
    text, match, place = F.col(text_col), F.col("match"), F.col("__place")
    offset = F.col(offset_col) if offset_col else F.lit(0).cast("long")
    line = F.col(line_col) if line_col else F.lit(1).cast("long")
    before, start = F.col("__before"), F.col("__start")
    left, right = F.col("__left"), F.col("__right")
    begin = F.greatest(F.lit(0), start - F.greatest(left, F.lit(0)))
    end = F.least(
        F.octet_length(text), start + F.octet_length(match) + F.greatest(right, F.lit(0))
    )
    context = (
        F.when((left <= 0) & (right <= 0), match)
        .when(place.isNotNull(), place["context"])
        .otherwise(byte_slice(text, begin, end))
    )
    carried = [c for c in matches.columns if c != "__matches"]
    located = (
        matches.withColumn("__places", places(text, F.col("__matches"), left, right))
        .select(*carried, "__places", F.posexplode_outer("__matches").alias("__n", "match"))
        .where(match.isNotNull() & long_enough(match))
        .withColumn("__place", F.col("__places")[F.col("__n")])
        .withColumn("__before", F.when(place.isNull(), before_first(text, match)))
        .withColumn("__start", F.coalesce(place["start"], byte_position(before)))
    )
    return located.select(
        *id_cols,
        "group",
        "rule_name",
        "match",
        context.alias("context"),
        (offset + start).alias("position"),
        (line + F.coalesce(place["newlines"], count_newlines(before))).alias("line_number"),
        "sensitive",
    ).select(*id_cols, *FINDING_COLUMNS)
