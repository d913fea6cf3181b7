"""Benchmark decontamination over a distributed positional inverted index, by DataFrame functions only.

Test items are cut into windows of 13 words. The index is a stored table of
postings (row, term, positions in order); terms that no window has are never
looked up and aren't stored. It has two tiers:

* the lookup tier holds, over all training texts, the two rarest terms of every
  window (frequencies are counted first; a window with a term that never occurs
  can't match and goes);
* where these two lists of a text, shifted by the terms' offsets, leave a place
  for the window, the text enters the full tier, which holds all its test terms.

A window's matches are then the intersection of its offset-adjusted lists, from
the rarest term on: an exact phrase where positions less offsets agree; a
proximity match at each place of the rarest term within whose reach (the window's
length - 1 + ``slop``) every other term stands, in any order.

Window tables are broadcast in blocks of at most ``BLOCK`` windows; a larger
benchmark takes one pass over the texts for each block. Postings shuffle by row
and term, so a frequent term spreads over all tasks.

Words are compared lower-cased (A-Z only). The join key is Spark's ``lower()``,
which merges at least as much; joined words are compared exactly.

Defined cases: null text has no words; items without words or without id are
ignored, repeated item ids count once; documents with equal id and text are
judged alike, one row each; ids may be null; texts of any length are whole;
columns that bear the name of a result give way to it, others stay; empty tables
give empty results or no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise

WINDOW = 13
#: Words more than its own length that a proximity match may span on either side.
SLOP = 5
#: Bound on the windows of one broadcast: a few hundred bytes each.
BLOCK = 100_000
#: Rows that a broadcast of row names may hold (32 MB); more are joined by a shuffle.
MOST_ROWS = 1_000_000
#: Separators in a text that still has capitals.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The term after a text's last word, whose position is the number of its words; no word can be it.
_END = "\x00"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, n, terms, items): distinct windows of lower-cased words with the ids that have them."""
    w = F.filter(F.split(lower_ascii(F.col(text_col)), _GAP), lambda x: x != "")
    cut = (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item"), F.explode(F.array(w)).alias("w"))
        .where(F.size("w") > 0)
        .select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("at"))
        .select("item", F.slice("w", F.col("at"), window).alias("terms"))
    )
    return cut.groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.monotonically_increasing_id().alias("win"), F.size("terms").alias("n"), "terms", "items")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a row by id and text."""
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(F.lit(7), text_col, id_col).alias("_k2")]


def _occurrences(docs: DataFrame, terms: DataFrame, *keep: str, text_col: str = "text", ends: bool = False) -> DataFrame:
    """(kept columns, pos from 0, term): every place of the ``terms`` (a table of bounded size) in the texts; with ``ends`` also that of each text's end."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a text that begins or ends with separators has an empty part there
    lead, trail = (text.rlike("^" + _GAP) | (text == "")).cast("int"), text.rlike(_GAP + "$").cast("int")
    parts = F.split(text, _GAP)
    parts = F.concat(parts, F.array(F.lit(_END))) if ends else parts
    # bound by a one-element explode: else the parts are split once for a filter on their number and once again
    rows = docs.select(*keep, lead.alias("_lead"), trail.alias("_trail"), F.explode(F.array(parts)).alias("_parts"))
    rows = rows.select(*keep, "_lead", "_trail", F.posexplode("_parts").alias("_at", "_word"))
    known = terms.select("term")
    known = F.broadcast((known.unionByName(docs.sparkSession.createDataFrame([(_END,)], "term string")) if ends else known).select("term", F.lower("term").alias("_low")))
    found = rows.join(known, F.lower("_word") == F.col("_low")).where(lower_ascii(F.col("_word")) == F.col("term"))
    pos = F.col("_at") - F.col("_lead") - F.when(F.col("term") == _END, F.col("_trail")).otherwise(0)
    return found.select(*keep, pos.alias("pos"), "term")


def postings(docs: DataFrame, terms: DataFrame, keys: list[str], text_col: str = "text", ends: bool = False) -> DataFrame:
    """(keys, term, at): the positions of each of the ``terms`` in each row, ascending; rows with equal keys count once."""
    found = _occurrences(docs, terms, *keys, text_col=text_col, ends=ends)
    return found.groupBy(*keys, "term").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, freq) of the given ``terms`` (a table of bounded size) in all texts."""
    return _occurrences(docs, terms, text_col=text_col).groupBy("term").agg(F.count("*").alias("freq"))


def ranked(wins: DataFrame, freq: DataFrame) -> DataFrame:
    """(win, n, items, lists, t1, o1, t2, o2): windows all of whose terms occur; ``lists``: their (freq, term, off), the rarest first; the two rarest terms with an offset of each."""
    places = wins.select("win", F.posexplode("terms").alias("off", "term")).join(freq, "term", "left")
    lists = places.groupBy("win").agg(F.min(F.coalesce("freq", F.lit(0))).alias("least"), F.sort_array(F.collect_list(F.struct("freq", "term", "off"))).alias("lists")).where("least > 0")
    first = F.get("lists", F.lit(0))
    second = F.get(F.filter("lists", lambda x: x["term"] != F.col("lists")[0]["term"]), F.lit(0))
    live = lists.join(wins.select("win", "n", "items"), "win")
    return live.select("win", "n", "items", "lists", first["term"].alias("t1"), first["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2"))


def _reach(slop: int | None) -> Column:
    """How far from the rarest term the other terms of a window may stand."""
    return F.greatest(F.col("n") - 1 + (slop or 0), F.lit(1))


def _around(at: Column, reach: Column) -> Column:
    """All places within ``reach`` of those given."""
    return F.flatten(F.transform(at, lambda q: F.sequence(q - reach, q + reach)))


def _candidates(index: DataFrame, live: DataFrame, keys: list[str], slop: int | None) -> DataFrame:
    """(keys, win): texts whose lists of a window's two rarest terms leave a place for it."""
    first = index.join(F.broadcast(live.select("win", "n", "t1", "t2")), F.col("term") == F.col("t1")).select(*keys, "win", "n", "t2", F.col("at").alias("l1"))
    second = index.select(*keys, F.col("term").alias("t2"), F.col("at").alias("l2"))
    both = first.where("t2 is not null").join(second, [*keys, "t2"])
    bins = lambda c, wide: F.transform(c, lambda p: F.floor(p / _reach(slop)) + wide)
    meet = F.arrays_overlap(F.concat(bins("l1", -1), bins("l1", 0), bins("l1", 1)), bins("l2", 0))
    return first.where("t2 is null").select(*keys, "win").unionByName(both.where(meet).select(*keys, "win"))


def _intersected(cand: DataFrame, index: DataFrame, live: DataFrame, keys: list[str], slop: int | None) -> DataFrame:
    """(keys, n, items, starts, near): the places of each candidate's window, by intersection from the rarest term on."""
    need = live.select("win", "n", F.posexplode("lists").alias("rank", "x")).select("win", "n", "rank", F.col("x.term").alias("term"), F.col("x.off").alias("off"))
    lists = cand.join(F.broadcast(need), "win").join(index, [*keys, "term"])
    told = lists.groupBy(*keys, "win").agg(F.sort_array(F.collect_list(F.struct("rank", "off", "term", "at"))).alias("l"), F.first("n").alias("n"))
    told = told.where(F.size("l") == F.col("n"))
    shifted = lambda x: F.transform(x["at"], lambda p: p - x["off"])
    rest = lambda c: F.slice(c, 2, F.size(c))
    starts = F.aggregate(rest(F.col("l")), F.filter(shifted(F.get("l", F.lit(0))), lambda p: p >= 0), lambda acc, x: F.when(F.size(acc) > 0, F.array_intersect(acc, shifted(x))).otherwise(acc))
    near = F.array().cast("array<int>")
    if slop is not None:
        others = F.filter("l", lambda x, k: (k > 0) & (x["term"] != F.get("l", k - 1)["term"]))  # equal terms stand side by side
        near = F.aggregate(others, F.get("l", F.lit(0))["at"], lambda acc, x: F.when(F.size(acc) > 0, F.array_intersect(acc, _around(x["at"], _reach(slop)))).otherwise(acc))
    out = told.select(*keys, "win", starts.alias("starts"), near.alias("near")).where((F.size("starts") > 0) | (F.size("near") > 0))
    return out.join(F.broadcast(live.select("win", "n", "items")), "win").select(*keys, "n", "items", "starts", "near")


def matches(docs: DataFrame, items: DataFrame, keys: list[str], window: int = WINDOW, slop: int | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, n, items, starts, near), a row for each window found in a row of ``docs``; and (keys, n_words) of all rows.

    ``starts``: first words of its exact phrases; ``near``, unless ``slop`` is
    None: places of its rarest term within whose reach all its terms stand.
    ``keys`` name a row and aren't null; rows with equal keys must have equal texts.
    """
    block = block or BLOCK
    wins = materialise(windows(items, window, item_col, item_text), "windows")
    blocks = max(1, -(-wins.count() // block))
    out = sizes = None
    for b in range(blocks):
        part = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        terms = part.select(F.explode("terms").alias("term")).distinct()
        freq = materialise(frequencies(docs, terms, text_col), "frequencies")
        live = materialise(ranked(part, freq), "live-windows")
        look = live.select(F.explode(F.array("t1", "t2")).alias("term")).where("term is not null").distinct()
        index = materialise(postings(docs, look, keys, text_col, ends=b == 0), "lookup-postings")
        if b == 0:
            sizes = index.where(F.col("term") == _END).select(*keys, F.col("at")[0].cast("long").alias("n_words"))
        cand = materialise(_candidates(index.where(F.col("term") != _END), live, keys, slop).distinct(), "candidates")
        rows = materialise(cand.select(*keys).distinct(), "candidate-rows")
        small = F.broadcast(rows) if rows.count() <= MOST_ROWS else rows
        full = materialise(postings(docs.join(small, keys, "left_semi"), live.select(F.explode("lists.term").alias("term")).distinct(), keys, text_col), "postings")
        found = materialise(_intersected(cand, full, live, keys, slop), "matches")
        discard(freq, live, index if b else None, cand, rows, full)
        out = found if out is None else out.unionByName(found)
    discard(wins)
    return out, sizes


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold any window; texts don't move, as long as the names of hit rows fit a broadcast."""
    own = row_keys(id_col, text_col)
    keyed = docs.select(id_col, text_col).select("*", *own)
    found, _ = matches(keyed, items, ["_k1", "_k2"], window, None, text_col, item_col, item_text)
    hit = materialise(found.where(F.size("starts") > 0).select("_k1", "_k2").distinct(), "hit-rows")
    hit = F.broadcast(hit) if hit.count() <= MOST_ROWS else hit
    return docs.select("*", *own).join(hit, ["_k1", "_k2"], "left_anti").select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), n_items, contaminated (``share`` * n_hit >= n_words > 0 and a hit), n_near and near_items (windows and ids of proximity matches, exact ones included).

    Columns of ``docs`` with these names give way to the new ones.
    """
    own = ["n_words", "n_hit", "items", "n_items", "contaminated", "n_near", "near_items"]
    keyed = docs.select(id_col, text_col).select("*", *row_keys(id_col, text_col))
    found, sizes = matches(keyed, items, ["_k1", "_k2"], window, slop, text_col, item_col, item_text)
    # the matches of one document; their number is bounded by its words and the windows at each
    per_doc = found.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("n", "items", "starts", "near")).alias("found"))
    spans = F.flatten(F.transform("found", lambda x: F.transform(x["starts"], lambda s: F.struct(s.alias("start"), (s + x["n"]).alias("end")))))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    hit = F.aggregate(F.sort_array(spans), zero, lambda acc, x: F.struct((acc["hit"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("hit"), F.greatest(x["end"], acc["end"]).alias("end")), lambda acc: acc["hit"])
    of = lambda name: F.filter("found", lambda x: F.size(x[name]) > 0)
    ids = lambda name: F.sort_array(F.array_distinct(F.flatten(F.transform(of(name), lambda x: x["items"]))))
    told = per_doc.select("_k1", "_k2", hit.alias("n_hit"), ids("starts").alias("items"), F.size(of("near")).alias("n_near"), ids("near").alias("near_items"))
    told = sizes.join(told, ["_k1", "_k2"], "left")
    kept = [c for c in docs.columns if c not in own]
    joined = docs.select(*kept, *row_keys(id_col, text_col)).join(told, ["_k1", "_k2"]).drop("_k1", "_k2")
    kind = items.schema[item_col].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    out = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_near")} | {c: F.coalesce(c, none) for c in ("items", "near_items")})
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
