"""Document fingerprints by order MinHash, in DataFrame expressions only.

The k-mers of a text are its runs of k words. The j-th occurrence of a k-mer counts as a k-mer of its own. A hash deals all of
them to bins and orders them within a bin; the least two of a bin, put back into text order, are hashed together to
the bin's entry. A bin with a single k-mer, as short texts have many, takes the next bin's first one to it, so that its entry tells of order
too. Texts share an entry if they share these k-mers in the same order, so that likeness falls with edit
distance, moves of passages included, not just with the sets' difference. One hash of each k-mer serves all bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

#: Words of a k-mer, bins (64: six bits) and k-mers kept in a bin.
K, BIN_BITS, TUPLE = 5, 6, 2
#: Bits of a position in the packed numbers that are sorted, which is more than a text can have words, of a k-mer's hash, and of its order in a bin.
POS, KMER_BITS, RANK_BITS = 31, 32, 26
SPACE = " \t\n\x0b\f\r"
#: Documents of a bucket of neighbouring ids, and the number of buckets up to which their heads are broadcast.
BUCKET_ROWS, SMALL = 2000, 500_000
#: Quantiles of all ids, which bound regions, and of a region's ids, which bound buckets: both lists are of bounded size.
REGIONS, WITHIN = 4096, 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _right(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def _runs(sorted_array: Column, shift: int) -> Column:
    """The indices at which x >> shift changes."""
    indices = F.when(F.size(sorted_array) > 0, F.sequence(F.lit(0), F.size(sorted_array) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(indices, lambda i: (i == 0) | (_right(F.get(sorted_array, i), shift) != _right(F.get(sorted_array, i - 1), shift)))


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def entries(text: Column, k: int = K) -> Column:
    """array<bigint>: for each bin that has k-mers, in order, bin << 32 | 32 bits of the hash of its tuple."""

    def kmer(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + j) for j in range(k)])  # a missing word is a null, which adds nothing

    def selected(w: Column) -> Column:
        starts = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))))
        by_kmer = F.sort_array(F.transform(starts, lambda i: F.shiftleft(_right(kmer(w, i), 64 - KMER_BITS), POS).bitwiseOR(i.cast("long"))))

        def ranked(x: Column, occurrence: Column) -> Column:
            h = F.xxhash64(_right(x, POS), occurrence)
            return F.shiftleft(_right(h, 64 - BIN_BITS - RANK_BITS), POS).bitwiseOR(x.bitwiseAND(F.lit((1 << POS) - 1)))

        def numbered(s: Column) -> Column:
            def with_runs(runs: Column) -> Column:
                again = F.flatten(F.transform(runs, lambda r, j: F.sequence(F.lit(0), F.coalesce(F.get(runs, j + 1), F.size(s)) - r - 1)))
                repeated = let(again, lambda occurrence: F.transform(s, lambda x, i: ranked(x, F.get(occurrence, i))))
                return F.when(F.size(runs) == F.size(s), F.transform(s, lambda x: ranked(x, F.lit(0)))).otherwise(repeated)

            return let(_runs(s, POS), with_runs)

        def least(t: Column) -> Column:
            return F.filter(t, lambda x, i: (i < TUPLE) | (_right(F.get(t, i - TUPLE), POS + RANK_BITS) != _right(x, POS + RANK_BITS)))

        minimal = let(F.sort_array(let(by_kmer, numbered)), least)
        return F.sort_array(F.transform(minimal, lambda x: F.shiftleft(_right(x, POS + RANK_BITS), POS).bitwiseOR(x.bitwiseAND(F.lit((1 << POS) - 1)))))

    def tuples(w: Column, o: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit((1 << POS) - 1)).cast("int")

        def one(runs: Column) -> Column:
            def entry(r: Column, j: Column) -> Column:
                other = F.when(r + 1 < F.coalesce(F.get(runs, j + 1), F.size(o)), r + 1).when(F.size(o) > 1, (r + 1) % F.size(o))
                pair = F.array_sort(F.filter(F.array(place(F.get(o, r)), place(F.get(o, other))), lambda p: p.isNotNull()))
                hashed = let(pair, lambda p: F.xxhash64(kmer(w, F.get(p, F.lit(0))), F.when(F.size(p) > 1, kmer(w, F.get(p, F.lit(1))))))
                return F.shiftleft(_right(F.get(o, r), POS), 32).bitwiseOR(_right(hashed, 32))

            return F.transform(runs, entry)

        return let(_runs(o, POS), one)

    return let(words(text), lambda w: let(selected(w), lambda o: tuples(w, o)))


def as_string(found: Column) -> Column:
    """Ten hex digits for each entry: two of the bin, eight of the hash."""
    return F.array_join(F.transform(found, lambda e: F.lpad(F.hex(e), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries among the bins that either has; 1 if both are empty."""
    bins = F.size(F.array_union(F.transform(a, lambda e: _right(e, 32)), F.transform(b, lambda e: _right(e, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _place(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are at most x, found in two steps of the root of their number."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    first = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= x))
    group = F.element_at(F.array(*map(longs, groups)), F.greatest(first, F.lit(1)))
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(group, lambda b: b <= x)))


def _with_buckets(docs: DataFrame) -> DataFrame:
    """docs (id, text) with tie, a hash of the text, and bucket: a number that falls along the order (id descending, nulls last; tie).

    Buckets hold about BUCKET_ROWS rows up to REGIONS * WITHIN buckets, whatever ids are like: regions lie between quantiles of all ids, buckets
    between quantiles of a region's. An id that fills several regions, and null, has one of its own that is cut by tie.
    """
    docs = docs.withColumn("tie", F.xxhash64("text"))
    shares = [k / REGIONS for k in range(1, REGIONS)]
    n, nulls, quantiles = docs.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull()), F.percentile_approx("id", shares, 10 * REGIONS)).first()
    wanted = max(1, n // BUCKET_ROWS)
    step = max(1, REGIONS // wanted)
    listed = (quantiles or [])[step - 1 :: step]
    heavy = sorted({q for q, after in zip(listed, listed[1:], strict=False) if q == after})
    bounds = sorted({*listed, *heavy, *(q + 1 for q in heavy if q < (1 << 63) - 1)})
    docs = docs.withColumn("region", F.when(F.col("id").isNotNull(), _place(bounds, F.col("id"))).otherwise(-1).cast("long"))
    parts = min(WITHIN, -(-wanted // REGIONS))
    within = F.lit(0)
    if parts > 1:
        inner = [k / parts for k in range(1, parts)]
        docs = docs.join(F.broadcast(docs.groupBy("region").agg(F.percentile_approx("id", inner, 100 * parts).alias("inner"))), "region", "left")  # REGIONS rows or so of WITHIN numbers
        within = F.size(F.filter(F.coalesce("inner", F.array().cast("array<bigint>")), lambda b: b <= F.col("id")))
    cut = lambda rows: min(WITHIN, max(1, -(-rows // BUCKET_ROWS)))
    # A hash of 64 bits as one of so many equal parts, the lowest hashes in the highest part.
    by_tie = lambda m: F.lit(WITHIN - 1) - F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * m).cast("int")
    place = F.when(F.col("id").isNull(), by_tie(cut(nulls)))
    for q in heavy:
        place = place.when(F.col("id") == q, by_tie(cut(listed.count(q) * step * n // REGIONS)))
    bucket = F.col("region") * WITHIN + F.greatest(F.lit(0), place.otherwise(within))
    return docs.select("id", "text", "tie", bucket.alias("bucket"))


def _neighbours(docs: DataFrame) -> DataFrame:
    """docs (id, text) dealt into buckets of neighbours, with the columns tie, bucket and guest.

    The rows of a bucket are followed, as a guest, by the first row of the next lower bucket that has any, and those of the lowest by the
    first row of all, so that every row's next one is in its own bucket.
    """
    docs = _with_buckets(docs)
    key = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("down"), "tie")
    heads = docs.groupBy("bucket").agg(F.min(key).alias("head")).withColumn("span", F.floor(F.col("bucket") / 4096))
    heads = materialize(heads, "heads")
    spans = heads.groupBy("span").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    spans = spans.withColumn("after", F.lead("first").over(Window.orderBy("span")))
    lowest = heads.agg(F.min("bucket")).first()[0]
    up = heads.withColumn("up", F.lead("bucket").over(Window.partitionBy("span").orderBy("bucket"))).join(spans, "span")
    up = up.select(F.col("bucket").alias("of"), "head", F.coalesce("up", "after", F.lit(lowest)).cast("long").alias("target"))
    if heads.count() <= SMALL:
        up = F.broadcast(up)
    first = docs.join(up, (F.col("bucket") == F.col("of")) & F.col("id").eqNullSafe(F.bitwise_not("head.down")) & (F.col("tie") == F.col("head.tie")))
    guests = first.groupBy(F.col("target").alias("bucket")).agg(F.min(F.struct("text", "id", "tie")).alias("row"))
    return docs.withColumn("guest", F.lit(0)).unionByName(guests.select("row.*", "bucket", F.lit(1).alias("guest")))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row of docs; see fingerprint_pairs for the cases."""
    return docs.select(F.col(id_col), as_string(entries(F.col(text_col))).alias("fingerprint"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document, by
    descending id; after the last comes the first. Rows with equal ids follow each other by a hash of the text, then the text; a null id comes last. A sole document is its own
    next one. A null text is an empty one; a text without words has an empty fingerprint, which is like another empty one
    (1) and unlike all others (0); a text of fewer than K words has one k-mer, all its words. Equal texts have equal
    fingerprints. Other columns are neither read nor returned; an empty table gives no rows. Texts move once, by bucket of ids.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _neighbours(narrow).withColumn("own", entries(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "tie", "text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order)).where("guest = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring("next", F.lit(1), F.col("cut")))
    rows = rows.select("id", "n_chars", "own", "next_own", edited.alias("edited"))
    judged = let(entries(F.col("edited")), lambda e: F.struct(as_string(e).alias("f"), likeness(F.col("own"), e).alias("near")))
    rows = rows.select("id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), judged.alias("judged"))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), F.col("judged.f").alias("edited_fingerprint"), F.col("judged.near").alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
