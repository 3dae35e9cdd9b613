"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, names (capitalised words inside a sentence) and units (after a number) become typed placeholders; windows of WINDOW template
tokens of the benchmark are hash-joined with every one of the documents: each common run of WINDOW tokens is found. A window with few literals would match
anywhere and is joined with its values instead; an item of up to WINDOW tokens is one window of its own length. Documents are hashed by the kinds of windows that the benchmark has.
Along each alignment that a join finds, runs of equal template tokens are laid out in whole, and their placeholders must be filled consistently: what stands
for one value of the item is one value in the document, and two values stay two. Items whose tokens are covered enough by consistent alignments are leaked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_key

WINDOW = 8  # also the tokens in a row that count
LITERALS = 4  # tokens of a window that must be no placeholder; others are compared with their values
SHORT = 3  # tokens from which an item of up to WINDOW tokens is looked for inside longer texts
WHOLE = 11  # tokens under which a text that equals an item's template is found whatever its literals
SHARE = 0.5  # of an item's tokens that must be covered
BROADCAST_ROWS = 100_000  # benchmark windows (about 40 bytes each) up to which they are broadcast; beyond, both sides are shuffled
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|ft|inches|inch|feet|foot|miles|mile|yards|meters|metres|kilometers|grams|kilograms|pounds|ounces|liters|litres|gallons|"
    "seconds|minutes|hours|days|weeks|months|years|percent|dollars|cents|euros|degrees|mph|kph|watts|volts|hz|kb|mb|gb|tb"
)
NUMBER, NAME, UNIT, JOINT = "", "", "", ""  # private-use characters; a text's own ones count as spaces
WHOLE_TEXT, RICH, POOR, OWN, OWN_RAW = 0, 1, 2, 10, 30  # kinds of windows
_TOKEN = f"[\\p{{L}}\\p{{N}}{NUMBER}-{JOINT}]+"


def _where(test: Column, then: Column, other: Column) -> Column:
    return F.when(test, then).otherwise(other)


def marked(text: Column) -> Column:
    """Lower-cased text in which a type mark leads each number, name and unit; separators inside numbers don't split them.

    Most texts have no digit and no private-use character: cheap tests keep their patterns from running.
    """
    t = F.coalesce(text, F.lit(""))
    own = t.contains(NUMBER) | t.contains(NAME) | t.contains(UNIT) | t.contains(JOINT)
    t = _where(own, F.regexp_replace(t, f"[{NUMBER}-{JOINT}]", " "), t)
    t = F.lower(F.regexp_replace(t, r"(\p{Ll},?\s{1,4})(?=\p{Lu}\p{Ll})", f"$1{NAME}"))
    n = F.regexp_replace(t, r"(\p{Nd})[.,](?=\p{Nd})", f"$1{JOINT}")
    n = F.regexp_replace(n, rf"(\p{{Nd}}) ?(?=(?:{UNITS})\b)", f"$1 {UNIT}")
    n = F.regexp_replace(n, rf"(?<![\p{{L}}\p{{N}}{JOINT}])(?=\p{{Nd}})", NUMBER)
    return _where(text.rlike(r"\p{Nd}"), n, t)


def raw_tokens(m: Column) -> Column:
    return F.regexp_extract_all(m, F.lit(_TOKEN), F.lit(0))


def template(m: Column) -> Column:
    """Tokens with each placeholder's value gone."""
    return F.regexp_extract_all(_where(m.rlike(f"[{NUMBER}-{UNIT}]"), F.regexp_replace(m, f"([{NUMBER}-{UNIT}])[\\p{{L}}\\p{{N}}{JOINT}]+", "$1"), m), F.lit(_TOKEN), F.lit(0))


def _literals(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~t.isin(NUMBER, NAME, UNIT)))


def _unnamed(token: Column) -> Column:
    """A raw token without the mark of a name: whether a text's first word has it depends on what stands before."""
    return F.translate(token, NAME, "")


def with_windows(df: DataFrame, kinds: set[int]) -> DataFrame:
    """df (text, ...) with tpl, its template tokens, and windows: (kind, pos, hash) of all windows of these kinds.

    WHOLE_TEXT: a list under WHOLE tokens; RICH: WINDOW template tokens; POOR: WINDOW raw tokens, of which under LITERALS are literal;
    OWN + n and OWN_RAW + n: n template or raw tokens. A column for each step, so that none is computed twice.
    """
    df = df.withColumn("marked", marked(F.col("text"))).withColumn("tpl", template(F.col("marked"))).withColumn("n", F.size("tpl"))
    own = [k for k in kinds if k > OWN]
    if POOR in kinds:
        mask = F.array_join(F.transform("tpl", lambda t: F.when(t.isin(NUMBER, NAME, UNIT), F.lit("1")).otherwise(F.lit("0"))), "")
        # a cheap necessary test: few texts have so many placeholders so close
        df = df.withColumn("dense", mask.rlike("1" + f".{{0,{LITERALS - 1}}}1" * (WINDOW - LITERALS)))
    if own:
        df = df.withColumn("raw", raw_tokens(F.col("marked")))
        df = df.withColumn("rhead", F.transform("raw", lambda t: F.when(t.startswith(NAME), _unnamed(t)).otherwise(t)))
        df = df.withColumn("head", F.transform("tpl", lambda t, i: F.when(t == NAME, F.get("rhead", i)).otherwise(t)))
    elif POOR in kinds:
        df = df.withColumn("raw", F.when(F.col("dense"), raw_tokens(F.col("marked"))))
    # windows are hashes of their tokens' hashes: each token is read once
    for name in ["tpl", *(["raw", "rhead", "head"] if own else ["raw"] if POOR in kinds else [])]:
        df = df.withColumn(f"{name}_h", F.transform(name, lambda t: F.xxhash64(t)))
    nil = F.array().cast("array<struct<kind:int,pos:int,hash:long>>")

    def one(kind: int, i: Column, *parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (i - 1).cast("int").alias("pos"), F.xxhash64(F.lit(kind), *parts).alias("hash"))

    def starts(width: int) -> Column:
        return F.sequence(F.lit(1), F.col("n") - width + 1)

    def series(kind: int) -> Column:
        if kind == WHOLE_TEXT:
            return F.when((F.col("n") > 0) & (F.col("n") < WHOLE), F.array(one(kind, F.lit(1), F.col("tpl_h")))).otherwise(nil)
        if kind == RICH:
            return F.when(F.col("n") >= WINDOW, F.transform(starts(WINDOW), lambda i: one(kind, i, F.slice("tpl_h", i, WINDOW)))).otherwise(nil)
        if kind == POOR:
            at = F.filter(starts(WINDOW), lambda i: _literals(F.slice("tpl", i, WINDOW)) < LITERALS)
            return F.when((F.col("n") >= WINDOW) & F.col("dense"), F.transform(at, lambda i: one(kind, i, F.slice("raw_h", i, WINDOW)))).otherwise(nil)
        first, rest, width = ("rhead_h", "raw_h", kind - OWN_RAW) if kind > OWN_RAW else ("head_h", "tpl_h", kind - OWN)
        return F.when(F.col("n") >= width, F.transform(starts(width), lambda i: one(kind, i, F.get(first, i - 1), F.slice(rest, i + 1, width - 1)))).otherwise(nil)

    return df.withColumn("windows", F.concat(nil, *(series(k) for k in sorted(kinds)))).drop("marked", "dense", "raw", "rhead", "head", "tpl_h", "raw_h", "rhead_h", "head_h")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """kind, hash -> places [(item, ipos)], where an item is (item_id, its own hash)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("item_key"), "text").distinct()
    items = with_windows(items, {WHOLE_TEXT, RICH, POOR, *(k + n for k in (OWN, OWN_RAW) for n in range(SHORT, WINDOW + 1))}).withColumnRenamed("n", "n_item")
    rows = items.select("item_id", "item_key", "n_item", "tpl", F.inline_outer("windows")).withColumnRenamed("pos", "ipos")
    n, kind = F.col("n_item"), F.col("kind")
    rich = _literals(F.slice("tpl", F.col("ipos") + 1, WINDOW)) >= F.least(F.lit(LITERALS), n)
    long = (n > WINDOW) & (((kind == RICH) & rich) | (kind == POOR))
    short = (n <= WINDOW) & (((kind == OWN + n) & rich) | ((kind == OWN_RAW + n) & ~rich))
    rows = rows.filter((kind == WHOLE_TEXT) | long | short)
    return rows.groupBy("kind", "hash").agg(F.collect_set(F.struct("item_id", "item_key", "n_item", "ipos")).alias("places"))


def small(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if it has no more than BROADCAST_ROWS rows (about 16 bytes each); else both sides are shuffled."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k1, k2, items: the leaked items (item_id) of each text that has any."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("item_key"), raw_tokens(marked(F.col("text"))).alias("iraw"), template(marked(F.col("text"))).alias("itpl")).distinct()
    windows = benchmark_windows(benchmark)
    kinds = {r.kind for r in windows.select("kind").distinct().collect()}
    few = windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = docs.select("text", *text_key(F.col("text")))
    # outer: else a filter on the array's size is inferred, pushed to the scan and computes every window there once more
    each = with_windows(keyed, kinds).select("k1", "k2", F.inline_outer("windows")).drop("kind")
    windows = windows.drop("kind")
    hits = each.join(F.broadcast(windows) if few else windows, "hash").select("k1", "k2", "pos", F.explode("places").alias("p")).select("k1", "k2", "pos", "p.*")
    # one alignment: the same distance between a document's and an item's tokens; repeated rows give the same places again
    lines = hits.select("k1", "k2", "item_id", "item_key", "n_item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    # read twice below; without a checkpoint every window would be hashed twice
    per_text = checkpointed(lines.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "item_key", "n_item", "shift")).alias("lines")))
    texts = keyed.join(small(per_text.select("k1", "k2")), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = texts.withColumn("m", marked(F.col("text"))).select("k1", "k2", raw_tokens(F.col("m")).alias("draw"), template(F.col("m")).alias("dtpl"))
    found = found.join(per_text, ["k1", "k2"]).select("k1", "k2", "draw", "dtpl", F.explode_outer("lines").alias("l")).select("k1", "k2", "draw", "dtpl", "l.*")
    found = found.join(items, (found["item_id"].eqNullSafe(items["item_id"])) & (found["item_key"] == items["item_key"])).select("k1", "k2", "draw", "dtpl", "iraw", "itpl", found["item_id"], found["item_key"], "n_item", "shift")
    first = lambda t, i: (i == 0) & (t == _unnamed(F.get("draw", F.col("shift"))))
    same = F.transform("itpl", lambda t, i: F.when((t == F.get("dtpl", i + F.col("shift"))) | first(t, i), F.lit("1")).otherwise(F.lit("0")))
    found = found.withColumn("same", F.array_join(same, "")).withColumn("run", F.least(F.lit(WINDOW), F.col("n_item")))
    whole = F.repeat(F.lit("1"), F.col("run"))
    inside = lambda i: F.exists(F.sequence(F.greatest(F.lit(0), i - F.col("run") + 1), i), lambda j: F.substring(F.col("same"), j + 1, F.col("run")) == whole)
    found = found.withColumn("covered", F.filter(F.sequence(F.lit(0), F.col("n_item") - 1), inside))
    slots = F.filter(F.transform("covered", lambda i: F.struct(F.get("iraw", i).alias("mine"), F.get("draw", i + F.col("shift")).alias("theirs"))), lambda s: s["mine"].rlike(f"^[{NUMBER}-{UNIT}]"))
    found = found.withColumn("pairs", F.array_distinct(slots))
    one_to_one = [F.size(F.array_distinct(F.transform("pairs", lambda s: s[side]))) == F.size("pairs") for side in ("mine", "theirs")]
    good = found.filter(one_to_one[0] & one_to_one[1])
    per_item = good.groupBy("k1", "k2", "item_id", "item_key", "n_item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"))
    leaked = per_item.filter(F.col("n_covered") >= F.col("n_item") * SHARE)
    return checkpointed(leaked.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (leaked item_ids, sorted) for each row of docs.

    docs: doc_id, text; benchmark: item_id, text (other columns are ignored). Tokens are runs of letters and digits in any case. Items of SHORT to
    WINDOW tokens are leaked by a text that holds them in whole, shorter ones only by a text that equals their template. Null and empty texts are clean and leak nothing, as are null
    and empty items; an item with a null id marks documents but is not listed. Rows with one text share a result; null doc_ids stay. Empty tables give empty or clean results.
    """
    leaks = find_leaks(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text"))).join(small(leaks), ["k1", "k2"], "left")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, whose text leaks no item."""
    names = ["__k1", "__k2"]
    leaks = find_leaks(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    leaks = small(leaks)
    a, b = text_key(F.col("text"))
    return docs.withColumns({"__k1": a, "__k2": b}).join(leaks, names, "left_anti").select(docs.columns)
