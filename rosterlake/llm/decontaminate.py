"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``index`` stores one posting (term, doc_id, pos) per corpus word that occurs in the benchmark; other words cannot
be part of a match.  ``phrase_matches`` starts from the postings of a window's rarest term, moved back by the term's
place in the window, and intersects them with the likewise moved postings of the second rarest.  The few places left
are completed with the window's other terms, read for the documents concerned only.  ``proximity_matches`` does the
same with a tolerance on every place.

Tables that are broadcast hold benchmark rows only, and only if they are counted first (``BROADCAST_ROWS``).
Everything else is joined by shuffles on (document, place), keys that no single term or passage can make hot.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import free_name

WINDOW = 10
BROADCAST_ROWS = 1 << 18     # benchmark terms or window places sent to all executors at most
BROADCAST_IDS = 1 << 20      # document ids sent to all executors at most (8 MB)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, all else as it is.  ``lower`` is faster, and the same for ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _pieces(text: Column) -> Column:
    """Words in their own case; the first and the last may be empty."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS)


def words(text: Column) -> Column:
    """Words of a short text; null has none."""
    return F.transform(F.filter(_pieces(text), lambda w: w != ""), lowered)


def _key(docs: DataFrame) -> Column:
    """Identity of a document: rows with equal id and text are interchangeable, a null id is a value."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def test_windows(items: DataFrame, size=WINDOW):
    """(places, owners) of the distinct windows of the benchmark's items.

    places: window, term, spot (0-based place in the window), size.  owners: window, item_id.  A window is a run of
    ``size`` consecutive item words; an item of fewer words, but not none, is one window.  Null items have none;
    items with a null id get no owner row, but their windows count as hits.
    """
    text = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    each = text.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at") + 1, F.least(F.lit(size), F.size("words"))).alias("terms"))
    each = each.withColumn("window", F.array_join("terms", " "))
    owners = each.select("window", F.col("item_id").cast("string").alias("item_id")).distinct()
    places = (each.select("window", "terms").dropDuplicates(["window"])
              .select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("spot", "term")))
    numbers = places.select("window").distinct().withColumn("w", F.xxhash64("window"))
    return (materialise(places.join(numbers, "window").select("w", "term", "spot", "size"), "places"),
            materialise(owners.join(numbers, "window").select("w", "item_id"), "owners"))


def index(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Positional index of the benchmark's terms: id (of the term), doc, pos.

    Positions count from 0 or 1, alike within a document.  Repeated rows repeat their postings.
    """
    terms = places.select("term").distinct().withColumn("id", F.xxhash64("term"))
    spread = docs.select(_key(docs).alias("doc"), F.posexplode(_pieces(docs["text"])).alias("pos", "word"))
    return (spread.select("doc", "pos", lowered(F.col("word")).alias("term"))
            .join(_small(terms, BROADCAST_ROWS), "term").select("id", "doc", "pos"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc, doc_id, n_words of every row."""
    return docs.select(_key(docs).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), _pieces(docs["text"]).alias("p")).select(
        "doc", "doc_id", F.greatest(F.lit(0), F.size("p") - (F.element_at("p", 1) == "").cast("int")
                                    - (F.element_at("p", -1) == "").cast("int")).cast("long").alias("n_words"))


def _ranked(postings: DataFrame, places: DataFrame) -> DataFrame:
    """places with ``rank`` 0 for the rarest term of its window, 1 for the next; terms the corpus lacks are rarest."""
    seen = postings.groupBy("id").agg(F.count("*").alias("df"))
    seen = _small(materialise(seen, "frequencies"), BROADCAST_ROWS)     # a row per term of the benchmark
    known = places.withColumn("id", F.xxhash64("term")).join(seen, "id", "left").fillna(0, ["df"])
    order = Window.partitionBy("w").orderBy("df", "spot")
    whole = F.min("df").over(Window.partitionBy("w")) > 0     # a window with an unseen term cannot occur
    return known.withColumn("rank", F.row_number().over(order) - 1).withColumn("whole", whole) \
        .filter("whole").select("w", "id", "spot", "size", "rank")


def _candidates(postings, ranked):
    """Window starts where the rarest and the second rarest term stand as the window asks."""
    def moved(rank):
        spots = ranked.filter(F.col("rank") == rank).select("w", "id", "spot", "size")
        return (postings.join(_small(spots, BROADCAST_ROWS), "id").filter("pos >= spot")
                .select("w", "doc", (F.col("pos") - F.col("spot")).alias("start"), "size"))
    one = moved(0)
    single = one.filter("size = 1")
    both = one.filter("size > 1").join(moved(1).drop("size"), ["w", "doc", "start"])
    return both.unionByName(single)


def _of_documents(postings, hits):
    ids = hits.select("doc").distinct()
    return postings.join(_small(ids, BROADCAST_IDS), "doc", "left_semi").distinct()


def phrase_matches(postings: DataFrame, places: DataFrame, ranked: DataFrame = None) -> DataFrame:
    """w, doc, start, size: every place where a window's terms stand in order without gaps."""
    ranked = materialise(_ranked(postings, places), "ranked") if ranked is None else ranked
    found = materialise(_candidates(postings, ranked).distinct(), "candidates")
    spots = _small(ranked.filter("rank > 1").select("w", F.col("id"), "spot"), BROADCAST_ROWS)
    asked = found.filter("size > 2").join(spots, "w").select(
        "w", "doc", "start", "size", "id", (F.col("start") + F.col("spot")).alias("pos"))
    full = (asked.join(_of_documents(postings, found.filter("size > 2")), ["doc", "pos", "id"])
            .groupBy("w", "doc", "start", "size").agg(F.count("*").alias("n")).filter("n = size - 2"))
    return full.drop("n").unionByName(found.filter("size <= 2"))


def _near_candidates(postings, ranked, slop):
    """Places of a window's rarest term from which the second rarest stands at most ``slop`` words off its own.

    Starts are joined by their band of ``slop + 1`` words, so a start meets three bands and no list is multiplied by shifts.
    """
    def moved(rank):
        spots = ranked.filter(F.col("rank") == rank).select("w", "id", "spot", "size")
        return postings.join(_small(spots, BROADCAST_ROWS), "id").select("w", "doc", (F.col("pos") - F.col("spot")).alias("start"), "size").distinct()
    band = F.floor(F.col("start") / (slop + 1))
    one = moved(0)
    two = moved(1).select("w", "doc", F.col("start").alias("other"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    both = one.filter("size > 1").withColumn("band", band).join(two, ["w", "doc", "band"]).filter(F.abs(F.col("other") - F.col("start")) <= slop)
    return both.select("w", "doc", "start", "size").distinct().unionByName(one.filter("size = 1"))


def proximity_matches(postings: DataFrame, places: DataFrame, slop=2, ranked: DataFrame = None) -> DataFrame:
    """w, doc, start: places where each of the window's terms stands within ``slop`` words of where it should.

    The place is that of the rarest term, moved back by its spot; it may lie before the text's first word.
    """
    ranked = materialise(_ranked(postings, places), "ranked") if ranked is None else ranked
    seeds = materialise(_near_candidates(postings, ranked, slop), "seeds")
    others = _small(ranked.filter("rank > 1").select("w", "id", "spot"), BROADCAST_ROWS)
    # tolerance as an equality: one row per allowed shift
    asked = seeds.filter("size > 2").join(others, "w").select("w", "doc", "start", "size", "id", "spot",
                                           F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("shift"))
    asked = asked.withColumn("pos", F.col("start") + F.col("spot") + F.col("shift"))
    full = (asked.join(_of_documents(postings, seeds.filter("size > 2")), ["doc", "pos", "id"])
            .groupBy("w", "doc", "start", "size").agg(F.countDistinct("spot").alias("n")).filter("n = size - 2"))
    return full.drop("n", "size").unionByName(seeds.filter("size <= 2").drop("size")).distinct()


def hit_words(matches: DataFrame) -> DataFrame:
    """doc, n_hit: words inside the union of a document's matches (a document's matches are bounded by its words)."""
    ends = matches.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))
    return ends.withColumn("reach", reach).groupBy("doc").agg(F.sum(fresh).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size=WINDOW, slop=2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near; one row per row of ``docs``.

    The first columns are of exact phrases.  n_near counts the windows whose terms all stand at most ``slop`` words from
    their places around the rarest one, so a passage with a word put in, left out or moved shows there.

    Null or wordless texts have no words and no hits; a null doc_id is kept.  Repeated rows get a row each, repeated
    items count once.  An empty benchmark contaminates nothing; an empty table gives an empty result.  Other columns
    are ignored.
    """
    places, owners = test_windows(items, size)
    postings = materialise(index(docs, places), "postings")
    ranked = materialise(_ranked(postings, places), "ranked")
    matches = materialise(phrase_matches(postings, places, ranked), "matches")
    near = proximity_matches(postings, places, slop, ranked).select("doc", "w").distinct().groupBy("doc").agg(F.count("*").alias("n_near"))
    found = (matches.select("doc", "w").distinct().join(_small(owners, BROADCAST_ROWS), "w").filter("item_id is not null")
             .select("doc", "item_id").distinct().groupBy("doc")
             .agg(F.sort_array(F.collect_list("item_id")).alias("ids")))   # no more ids than a document has words
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    hits = hit_words(matches).join(found, "doc", "left").join(near, "doc", "full")
    return sizes(docs).join(hits, "doc", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, size=WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; every other row goes."""
    places, _ = test_windows(items, size)
    postings = materialise(index(docs, places), "postings")
    name = free_name(docs, "contaminated_doc")
    bad = materialise(phrase_matches(postings, places).select(F.col("doc").alias(name)).distinct(), "contaminated")
    return docs.join(_small(bad, BROADCAST_IDS), _key(docs) == F.col(name), "left_anti")
