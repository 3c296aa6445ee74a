"""Vocabularies: merging, enrichment, term index, and matching terms in text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions import text as fx
from skillweave.session import materialise, small_batches

LONGEST_TERM = 6


def variants(entries: DataFrame) -> DataFrame:
    """One row per variant of an entry (its term, then its aliases), with ``variant_ord``; nothing is made distinct."""
    every = F.filter(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return entries.select("*", F.posexplode(every).alias("variant_ord", "variant"))


def merge(entries: DataFrame) -> DataFrame:
    """Entries (with ``ord``) merged by (entity_type, lower term): first id, term and source, first non-empty description, aliases in order."""
    described = F.when(F.col("description") != "", F.col("ord"))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    # Each alias of a key shrinks to its first place before a key's aliases are gathered, however many entries have the key.
    rows = entries.select("entity_type", F.lower("term").alias("term_key"), "ord", F.struct("canonical_id", "term", "source").alias("own"), "description", described.alias("described"), aliases.alias("aliases"))
    rows = rows.select("*", F.posexplode_outer("aliases").alias("pos", "alias"))
    firsts = rows.groupBy("entity_type", "term_key", "alias", F.isnull("pos").alias("none")).agg(
        F.min(F.struct("ord", "aliases", "pos")).alias("at"), F.min("ord").alias("ord"), F.min_by("own", "ord").alias("own"), F.min("described").alias("described"), F.min_by("description", "described").alias("description")
    )
    kept = F.array_sort(F.collect_list(F.when(~F.col("none"), F.struct("at", "alias"))))
    merged = firsts.groupBy("entity_type", "term_key").agg(
        F.min_by("own", "ord").alias("first"), F.coalesce(F.min_by("description", "described"), F.lit("")).alias("description"), F.transform(kept, lambda x: x["alias"]).alias("aliases")
    )
    return merged.select("first.canonical_id", "entity_type", "first.term", "first.source", "description", "aliases")


def curated_entries(spark: SparkSession) -> DataFrame:
    """The curated technology terms as entries, in their fixed order."""
    rows = [(k, kind, label, raw) for k, (raw, (kind, label)) in enumerate(fx.TECH_TERMS.items())]
    base = spark.createDataFrame(rows, "ord int, entity_type string, term string, raw string")
    return base.select("ord", F.concat(F.lit("local:"), F.lower("entity_type"), F.lit(":"), fx.slug(F.col("term"))).alias("canonical_id"), "entity_type", "term", F.lit("curated").alias("source"), F.lit("").alias("description"), F.array("raw").alias("aliases"))


def occupation_entries(titles: DataFrame) -> DataFrame:
    """Entries for clean titles (title, ord): one per lower-case title, the first spelling."""
    one = titles.filter(F.col("title") != "").groupBy(F.lower("title").alias("k")).agg(F.min_by("title", "ord").alias("term"), F.min("ord").alias("ord"))
    return one.select("ord", F.concat(F.lit("local:occ:"), fx.occupation_slug(F.col("term"))).alias("canonical_id"), F.lit("OCC").alias("entity_type"), "term", F.lit("job_title").alias("source"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))


def enrich(base: DataFrame, titles: DataFrame) -> DataFrame:
    """Base entries (the last of a key wins), then curated terms and titles whose (entity_type, lower term) isn't there."""
    columns = ["ord", "canonical_id", "entity_type", "term", "source", "description", "aliases"]
    parts = [base.select(columns).withColumn("level", F.lit(0)), curated_entries(base.sparkSession).select(columns).withColumn("level", F.lit(1)), occupation_entries(titles).select(columns).withColumn("level", F.lit(2))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = F.struct("level", F.when(F.col("level") == 0, -F.col("ord")).otherwise(F.col("ord")))
    own = F.struct("canonical_id", "term", "source", "description", "aliases")
    return every.groupBy("entity_type", F.lower("term").alias("k")).agg(F.min_by(own, order).alias("x")).select("entity_type", "x.*")


def indexable(term: Column, kind: Column, source: Column, toks: Column) -> Column:
    """Whether a term may be looked up in text: its type, no generic word, no short or ambiguous single word unless curated."""
    low = F.lower(term)
    single = F.size(toks) == 1
    weak = single & (source != "curated") & ((F.length(term) < 3) | low.isin(*fx.AMBIGUOUS_TERMS))
    return kind.isin("SKL", "TOL", "KNW") & ~low.isin(*fx.GENERIC_TERMS) & ~weak & term.rlike(r"\p{L}")


def term_index(entries: DataFrame) -> DataFrame:
    """key -> entry for variants of indexable terms of at most 6 tokens: curated ones first (the last of them), else the first."""
    rows = variants(entries).withColumn("toks", fx.tokens(F.col("variant")))
    rows = rows.filter((F.size("toks") > 0) & (F.size("toks") <= LONGEST_TERM) & indexable(F.col("variant"), F.col("entity_type"), F.col("source"), F.col("toks")))
    curated = F.col("source") == "curated"
    order = F.struct(F.when(curated, 0).otherwise(1).alias("tier"), F.when(curated, -F.col("ord")).otherwise(F.col("ord")).alias("ord"), "variant_ord")
    return rows.groupBy(fx.token_key(F.col("toks")).alias("key")).agg(F.min_by(F.struct("canonical_id", "entity_type", "term"), order).alias("entry"), F.first(F.size("toks")).alias("n_tokens"))


def ngram_match(sentences: DataFrame, index: DataFrame) -> DataFrame:
    """Leftmost-longest term matches: id, start_token, n_tokens, canonical_id, entity_type, term.

    Each token is looked up once among the first tokens of terms, with the (at most 6) tokens from it on; only where a term
    begins so, n-grams are made, of the lengths that such terms have, and looked up.  Both are equi-joins, which Spark
    broadcasts if the index is small enough; only what matches is gathered by sentence for the choice from the left.
    """
    low = sentences.select("id", F.transform(fx.tokens(F.col("text")), lambda t: F.lower(t)).alias("toks"))
    ahead = F.transform("toks", lambda t, i: F.struct(i.alias("start_token"), F.substring_index(t, "\x01", 1).alias("head"), F.slice("toks", i + 1, F.lit(LONGEST_TERM)).alias("ahead")))
    placed = low.select("id", F.explode(ahead).alias("p")).select("id", "p.*")
    heads = index.groupBy(F.substring_index("key", "\x01", 1).alias("head")).agg(F.collect_set("n_tokens").alias("lengths"))  # at most LONGEST_TERM of them
    likely = placed.join(heads, "head").select("id", "start_token", "ahead", F.explode("lengths").alias("n_tokens")).filter(F.col("n_tokens") <= F.size("ahead"))
    keyed = likely.select("id", "start_token", "n_tokens", F.array_join(F.slice("ahead", F.lit(1), F.col("n_tokens")), "\x01").alias("key"))
    hits = keyed.join(index.select("key", "entry"), "key")
    longest = hits.groupBy("id", "start_token").agg(F.max(F.struct("n_tokens", "entry")).alias("x"))
    rows = longest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_token", "x.n_tokens", "x.entry"))).alias("rows"))
    empty = F.slice("rows", 1, 0)

    def take(acc: Column, r: Column) -> Column:
        free = r["start_token"] >= acc["upto"]
        return F.struct(F.when(free, r["start_token"] + r["n_tokens"]).otherwise(acc["upto"]).alias("upto"), F.when(free, F.array_append(acc["out"], r)).otherwise(acc["out"]).alias("out"))

    chosen = F.aggregate("rows", F.struct(F.lit(0).alias("upto"), empty.alias("out")), take)["out"]
    flat = rows.select("id", F.explode(chosen).alias("r"))
    return flat.select("id", "r.start_token", "r.n_tokens", "r.entry.canonical_id", "r.entry.entity_type", "r.entry.term")


def gazetteer_features(sentences: DataFrame, entries: DataFrame) -> DataFrame:
    """All matches merged per token: id, pos, types (sorted), type (least), span_len (longest), begin."""
    terms = variants(entries).select(fx.feature_tokens(F.col("variant")).alias("toks"), "entity_type").filter(F.size("toks") > 0)
    terms = terms.select(F.array_join("toks", "\x01").alias("key"), F.size("toks").alias("n"), "entity_type").distinct()
    lengths = [r.n for r in terms.select("n").distinct().orderBy("n").collect()]
    toks = sentences.select("id", F.transform(F.col("tokens"), lambda t: F.lower(t)).alias("toks"))
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    def grams_at(i: Column) -> Column:
        fitting = F.filter(sizes, lambda n: i + n <= F.size("toks"))
        return F.transform(fitting, lambda n: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice("toks", i + 1, n), "\x01").alias("key")))

    grams = F.flatten(F.transform("toks", lambda t, i: grams_at(i)))
    keyed = toks.select("id", F.explode(grams).alias("g")).select("id", "g.start", "g.n", "g.key")
    hits = keyed.join(terms, ["key", "n"])
    covered = hits.select("id", "entity_type", "n", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    return covered.groupBy("id", "pos").agg(
        F.array_sort(F.collect_set("entity_type")).alias("types"), F.min("entity_type").alias("type"), F.max("n").alias("span_len"), F.bool_or(F.col("pos") == F.col("start")).alias("begin")
    )


def _even_lower(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


#: Bits of the filter of each seed length; longest seed as a power of two; characters that are hashed together.
FILTER_BITS, LONGEST_SEED, CHARS_AT_ONCE = 1 << 22, 5, 250_000
SEEDS = "size int, seed bigint"
MENTIONS = "array<struct<start:int,end:int,entity_type:string,canonical_id:string>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _seed_hashes(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Offsets of the lowered texts laid end to end, characters left in each text from each on, and for k = 0, 1, ... up to
    ``longest`` the hash of the 2**k characters from each on (of no use where fewer are left)."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    size = np.array([len(p) for p in points], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    left = np.repeat(offsets[1:], size) - np.arange(offsets[-1])
    with np.errstate(over="ignore"):
        now = _mixed(np.concatenate([*points, np.zeros(0, "<u4")]).astype(np.uint64) + np.uint64(0x517CC1B727220A94))
        out = [now]
        for k in range(longest):
            after = np.zeros_like(now)
            after[: -(1 << k) or None] = now[1 << k :]
            now = _mixed(now * np.uint64(0xA24BAED4963EE407) + after)
            out.append(now)
    return offsets, left, out


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of whole texts with about ``CHARS_AT_ONCE`` characters."""
    begin = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > CHARS_AT_ONCE:
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def _string_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, ...) -> the same with the length of its seed as a power of two, and the seed's hash."""
    for batch in batches:
        low = batch.column(0).to_pylist()
        offsets, _, hashes = _seed_hashes([x[: 1 << LONGEST_SEED] for x in low], LONGEST_SEED)
        size = np.array([min(len(x).bit_length() - 1, LONGEST_SEED) for x in low], np.int32)
        seed = np.array([hashes[k][i] for k, i in zip(size.tolist(), offsets[:-1].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(seed.view(np.int64))], names=[*batch.schema.names, "size", "seed"])


def _seed_filter(strings: DataFrame) -> dict[int, np.ndarray]:
    """For each seed length a bitmap of the hashes there are: what the driver and the tasks know of a vocabulary, whatever its size."""
    cell = F.pmod("seed", F.lit(FILTER_BITS))
    words = strings.select("size", F.floor(cell / 8).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1), (cell % 8).cast("int")).alias("bit")).groupBy("size", "word").agg(F.bit_or("bit").alias("bits"))
    out: dict[int, np.ndarray] = {}
    rows = words.toArrow()  # at most FILTER_BITS / 8 for each of LONGEST_SEED + 1 lengths
    size, word, bits = (rows.column(c).to_numpy() for c in ("size", "word", "bits"))
    for k in np.unique(size).tolist():
        out[k] = np.zeros(FILTER_BITS // 8, np.uint8)
        out[k][word[size == k]] = bits[size == k]
    return out


def _places(shared):
    """(key, low) -> (key, pos, size, seed) of the places whose characters may begin a string of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            every = batch.column(1).to_pylist()
            for begin, end in _runs(every):
                low = [_even_lower(x) for x in every[begin:end]]
                offsets, left, hashes = _seed_hashes(low, max(known, default=0))
                for k, bitmap in known.items():
                    cell = (hashes[k].view(np.int64) % FILTER_BITS).astype(np.int64)
                    at = np.flatnonzero((left >= 1 << k) & ((bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))
                    row = np.searchsorted(offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(begin + row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(hashes[k][at].view(np.int64))], names=["key", "pos", "size", "seed"]
                    )

    return run


def _resolve(text: str | None, found: list | None) -> list[dict]:
    """Mentions of one text: candidates that are there, each string's from the left without overlap, then longer ones first."""
    if not found or text is None:
        return []
    low, by_string = _even_lower(text), {}
    for f in found:
        if low.startswith(f["low"], f["pos"]):
            by_string.setdefault(f["low"], []).append(f)
    candidates = []
    for string, own in by_string.items():
        upto = 0
        for f in sorted(own, key=lambda f: f["pos"]):
            if f["pos"] >= upto:
                upto = f["pos"] + len(string)
                candidates.append((-len(string), f["pos"], upto, f["entity_type"], f["canonical_id"]))
    taken, out = np.zeros(len(low), bool), []
    for _, start, end, kind, cid in sorted(candidates, key=lambda c: c[:2]):
        if not taken[start] and not taken[end - 1] and not taken[start:end].any():
            taken[start:end] = True
            out.append({"start": start, "end": end, "entity_type": kind, "canonical_id": cid})
    return sorted(out, key=lambda m: m["start"])


def char_match(sentences: DataFrame, entries: DataFrame) -> DataFrame:
    """``sentences`` (id, text) with mentions array<struct<start,end,entity_type,canonical_id>>.

    Every variant is searched in any case and without word borders; longer matches win, then earlier ones; of entries with
    one variant the first counts.  The first 1, 2, 4, ... characters of each variant, as many as fit, are its seed.  Places
    of the texts that pass a small bitmap of all seeds meet the variants in a join on the seed's hash, and what meets is
    compared with the text.  The vocabulary itself is never on the driver, and it may be of any size.
    """
    spark = sentences.sparkSession
    small_batches(spark)
    lower = F.udf(_even_lower, "string", useArrow=True)
    rows = variants(entries).filter(F.length("variant") > 0).select(lower("variant").alias("low"), "ord", "variant_ord", "entity_type", "canonical_id")
    owner = F.min_by(F.struct("entity_type", "canonical_id"), F.struct("ord", "variant_ord")).alias("owner")
    plain = rows.groupBy("low").agg(owner).select("low", "owner.entity_type", "owner.canonical_id")
    strings = materialise(plain.mapInArrow(_string_seeds, f"low string, entity_type string, canonical_id string, {SEEDS}"))
    shared = spark.sparkContext.broadcast(_seed_filter(strings))
    keyed = sentences.withColumn("_key", F.sha2(F.col("text").cast("string"), 256))
    places = keyed.filter("text is not null").select(F.col("_key").alias("key"), F.col("text").cast("string")).mapInArrow(_places(shared), f"key string, pos int, {SEEDS}")
    met = places.join(strings, ["size", "seed"]).groupBy("key").agg(F.collect_set(F.struct("pos", "low", "entity_type", "canonical_id")).alias("_found"))
    resolve = F.udf(_resolve, MENTIONS, useArrow=True)
    joined = keyed.join(met.withColumnRenamed("key", "_key"), "_key", "left")
    return joined.withColumn("mentions", resolve(F.col("text").cast("string"), "_found")).select(*sentences.columns, "mentions")
