"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds postings (document, position, term) for the terms that queries start from: a first pass counts how often
each benchmark term occurs in the whole corpus, and every window of a benchmark item is looked up by its rarest terms.
Their lists are shifted by the terms' offsets in the window and intersected by stretches of ``STRETCH`` starts, which
leaves candidates (document, stretch, window). Postings of a window's rarest term also hold the words around it, so each
start is compared with all words of the window without another look at the document: exactly, and for proximity, where
every word of the window lies within ``slack`` words of its place.

Terms and windows of the benchmark are broadcast if they are few enough (``SMALL``). Else they are joined by a shuffle on
the term, with ``SALTS`` parts a term, after rows have been aggregated where they can be; all later rows are keyed by
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import rows

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a benchmark table that may be broadcast; a row takes about 300 bytes.
SMALL = 100_000
#: Parts of a term's rows beyond that.
SALTS = 32
#: Rarest terms of a window whose lists are intersected, and starts of a stretch.
ANCHORS, STRETCH = 2, 16


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and all beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), BETWEEN), "")


def _meet(rows: DataFrame, table: DataFrame, on: str | list[str], salt: Column | None = None) -> DataFrame:
    """``rows`` joined with a table of the benchmark: a broadcast up to ``SMALL`` rows, else a shuffle, by parts if salted."""
    on = [on] if isinstance(on, str) else on
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table), on)
    if salt is None:
        return rows.join(table.hint("merge"), on)
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(parts.hint("merge"), [*on, "_salt"]).drop("_salt")


def windows(items: DataFrame, width: int) -> DataFrame:
    """Windows of the items (item_id, text), once an item: item (the id as string; a null id is ''), phrase, terms."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    each = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("terms"))
    return each.select("item", F.concat_ws(" ", "terms").alias("phrase"), "terms").dropDuplicates(["item", "phrase"])


def _postings(tokens: DataFrame, chosen: DataFrame, reach: int, spread: Column) -> DataFrame:
    """Postings of ``tokens`` (doc_id, h, w) for more terms than a broadcast holds: doc_id, h, pos, term, low, around.

    Only places and terms go to the terms. A document's words move once, to the places that were found in it.
    """
    places = tokens.select("doc_id", "h", F.posexplode("w").alias("pos", "term"))
    found = stored(_meet(places, chosen, "term", spread).select("doc_id", "h", "pos", "term", "lead"), "bench-places")
    plain = found.where("not lead").select("doc_id", "h", "pos", "term", F.lit(None).cast("int").alias("low"), F.lit(None).cast("array<string>").alias("around"))
    own = found.where("lead").groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "term")).alias("own")).select(F.col("doc_id").alias("id"), F.col("h").alias("k"), "own")
    met = tokens.join(own.hint("merge"), tokens["doc_id"].eqNullSafe(own["id"]) & (tokens["h"] == own["k"])).select("doc_id", "h", "w", "own")
    low = lambda x: F.greatest(x["pos"] - reach, F.lit(0))
    cut = F.transform("own", lambda x: F.struct(x["pos"].alias("pos"), x["term"].alias("term"), low(x).alias("low"), F.slice("w", low(x) + 1, x["pos"] + reach + 1 - low(x)).alias("around")))
    return plain.unionByName(met.select("doc_id", "h", F.explode(cut).alias("x")).select("doc_id", "h", "x.*"))


def matches(docs: DataFrame, items: DataFrame, width: int = 10, slack: int = 0) -> tuple[DataFrame, DataFrame]:
    """Occurrences of item windows in ``docs``, and which items have a window.

    The first has doc_id, h (hash of the text), window (its number), stretch, n (words of the window), exact (bits of the
    starts in the stretch at which all its words follow one another) and near (whether at a start of the stretch every word
    is within ``slack`` words of its place; exact ones are near too); the second window and item.
    """
    each = stored(windows(items, width), "bench-windows")
    phrases = stored(each.groupBy("phrase").agg(F.first("terms").alias("terms")).withColumn("window", F.monotonically_increasing_id()), "bench-phrases")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    terms = phrases.select(F.explode("terms").alias("term")).distinct()
    seen = tokens.select(F.explode("w").alias("term"))
    if terms.count() > SMALL:  # a frequent term is summed where it is read, before it meets the terms
        counts = seen.groupBy("term").agg(F.count("*").alias("df")).join(terms.hint("merge"), "term")
    else:
        counts = seen.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    counts = stored(counts, "bench-counts")
    parts = phrases.select("window", "phrase", "terms", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    own = Window.partitionBy("window")
    ranked = parts.withColumn("rank", F.row_number().over(own.orderBy(F.coalesce("df", F.lit(0)), "offset"))).withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(own))
    anchors = stored(ranked.where(f"least > 0 and rank <= {ANCHORS}").select("window", "phrase", "terms", "n", "offset", "term", "rank"), "bench-anchors")
    chosen = anchors.groupBy("term").agg(F.max(F.col("rank") == 1).alias("lead"))
    reach = width - 1 + 2 * slack
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.when(F.col("lead"), F.slice("w", low + 1, F.col("pos") + reach + 1 - low))
    spread = F.xxhash64("doc_id", "h", "pos")
    if chosen.count() <= SMALL:
        postings = tokens.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(chosen), "term")
        postings = postings.select("doc_id", "h", "pos", "term", low.alias("low"), around.alias("around"))
    else:
        postings = _postings(tokens, chosen, reach, spread)
    postings = stored(postings, "postings")
    start = F.col("pos") - F.col("offset")
    second = anchors.where("rank = 2").select("window", F.col("term").alias("other"))
    leads = anchors.where("rank = 1").join(second, "window", "left")
    lead = _meet(postings, leads, "term", spread).where(F.col("pos") >= F.col("offset") - slack)
    lead = lead.withColumn("start", start).withColumn("at", F.col("pos") - F.col("offset") - F.col("low"))  # of the start in the words around
    same = (F.col("start") >= 0) & (F.concat_ws(" ", F.slice("around", F.greatest("at", F.lit(0)) + 1, F.col("n"))) == F.col("phrase"))

    def within(shift: int) -> Column:
        """Whether every word of the window is within ``slack`` of its place, counted from this shift of the start."""

        def there(term: Column, j: Column) -> Column:
            first = F.col("at") + j + (shift - slack)
            return F.array_contains(F.slice("around", F.greatest(first, F.lit(0)) + 1, F.greatest(F.least(F.lit(2 * slack + 1), first + (2 * slack + 1)), F.lit(0))), term)

        return (F.col("start") + shift >= 0) & F.forall(F.transform("terms", there), lambda x: x)

    near = F.lit(False)
    for shift in range(-slack, slack + 1) if slack else ():
        near = near | within(shift)
    lead = lead.withColumn("same", same)
    near = F.col("same") | F.when(F.col("other").isNull() | F.array_contains("around", F.col("other")), near).otherwise(False)
    stretch = lambda x: F.floor(x / STRETCH).cast("int")
    bits = F.when(F.col("same"), F.expr(f"shiftleft(1, cast(pmod(start, {STRETCH}) as int))")).otherwise(F.lit(0))
    lead = lead.select("doc_id", "h", "window", stretch(F.col("start")).alias("stretch"), F.lit(1).alias("met"), bits.alias("exact"), near.alias("near"))
    rest = _meet(postings.drop("around"), anchors.where("rank = 2").select("window", "term", "offset"), "term", spread).where(F.col("pos") >= F.col("offset") - 2 * slack)
    into = F.explode(F.array_distinct(F.array(stretch(start - 2 * slack), stretch(start + 2 * slack)))) if slack else stretch(start)
    rest = rest.select("doc_id", "h", "window", into.alias("stretch"), F.lit(2).alias("met"), F.lit(0).alias("exact"), F.lit(False).alias("near"))
    met = lead.unionByName(rest).groupBy("doc_id", "h", "window", "stretch").agg(F.bit_or("met").alias("met"), F.bit_or("exact").alias("exact"), F.max("near").alias("near"))
    need = anchors.groupBy("window").agg(F.bit_or("rank").alias("need"), F.first("n").alias("n"))
    found = _meet(met.where("near"), need, "window").where("met = need")
    return found.select("doc_id", "h", "window", "stretch", "n", "exact", "near"), each.join(phrases.select("phrase", "window"), "phrase").select("window", "item")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slack: int = 2) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text), against ``items`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside exact occurrences of windows), n_items, items_sha256, contaminated, and
    n_near (distinct windows that the document has by proximity and nowhere exactly: from some start every word of the
    window occurs within ``slack`` words of its place). A window is ``width`` consecutive words of an item, or a whole
    shorter item. Null and empty texts have no words and no hits; an item without words or a null item text matches
    nothing; null and repeated doc_ids keep their rows; empty tables give empty results or no hits; other columns are not
    read.
    """
    found, members = matches(docs, items, width, slack)
    found = stored(found, "bench-found")
    exact = found.where("exact <> 0")
    starts = F.filter(F.sequence(F.lit(0), F.lit(STRETCH - 1)), lambda k: F.col("exact").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    inside = F.flatten(F.transform(starts, lambda k: F.sequence(F.col("stretch") * STRETCH + k, F.col("stretch") * STRETCH + k + F.col("n") - 1)))
    hits = exact.groupBy("doc_id", "h").agg(F.size(F.array_distinct(F.flatten(F.collect_list(inside)))).cast("long").alias("n_hit"))
    names = _meet(exact.select("doc_id", "h", "window").distinct(), members, "window").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    by_window = found.groupBy("doc_id", "h", "window").agg(F.max(F.col("exact") != 0).alias("is_exact"))
    nears = by_window.groupBy("doc_id", "h").agg(F.count_if(~F.col("is_exact")).alias("n_near"))
    key = lambda t, *cols: t.select(F.col("doc_id").alias("id"), F.col("h").alias("k"), *cols)
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["k"] == b["k"])
    nears, hits, names = key(nears, "n_near"), key(hits, "n_hit"), key(names, "ids")
    per = nears.join(hits, same(nears, hits), "left").select(nears["id"], nears["k"], "n_near", "n_hit")
    per = stored(per.join(names, same(per, names), "left").select(per["id"], per["k"], "n_near", "n_hit", "ids"), "bench-hits")
    every = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        F.col("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    found = matches(docs, items, width)[0].where("exact <> 0").select("doc_id", "h").distinct()
    hit = stored(found, "bench-documents").toDF("id", "k").hint("merge")
    h = rows.fresh(docs, "_h")[0]
    marked = docs.withColumn(h, F.xxhash64(docs["text"]))
    return marked.join(hit, marked["doc_id"].eqNullSafe(hit["id"]) & (marked[h] == hit["k"]), "left_anti").select(*docs.columns)
