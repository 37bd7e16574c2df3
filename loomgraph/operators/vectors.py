"""Hash embeddings, vector points and filtered cosine search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import WORD, strip
from loomgraph.operators.graph import latest
from loomgraph.session import cut

#: Name space of point ids (the DNS name space of RFC 4122).
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: More queries than this are not broadcast.
BROADCAST_QUERIES = 10_000
#: Fixed values, in hundredths: weights of a word of up to five letters, of a longer one and of
#: a run of three characters.
SHORT_WORD, LONG_WORD, TRIPLE = 100, 200, 35


def md5_mod(col: Column, modulus: int) -> Column:
    """MD5 of a string as a 128-bit number, modulo a small number."""
    digest = F.md5(col)
    out = F.lit(0).cast("bigint")
    for at in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
        out = (out * F.lit(2**32 % modulus) + word) % modulus
    return out.cast("int")


def _pieces(low: Column) -> Column:
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    heavy = F.transform(words, lambda w: F.struct(w.alias("piece"), F.when(F.length(w) > 5, F.lit(LONG_WORD)).otherwise(F.lit(SHORT_WORD)).alias("w")))
    n = F.length(low)
    runs = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.struct(F.substring(low, i, F.lit(3)).alias("piece"), F.lit(TRIPLE).alias("w")))).otherwise(F.array().cast("array<struct<piece:string,w:int>>"))
    return F.concat(heavy, runs)


def hash_weights(texts: DataFrame, id_col: str, text_col: str, dimension: int = 1536) -> DataFrame:
    """Sparse embeddings: the id column, idx, weight (hundredths, exact integers).

    A piece goes to bucket MD5 mod dimension with a sign by the parity of its MD5. Equal pieces
    of a text are counted before they are hashed. A blank or null text is the unit vector
    (idx 0, weight 100). Repeated ids must be dropped before.
    """
    blank = strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    lowered = texts.where(~blank).select(F.col(id_col), F.lower(F.col(text_col)).alias("__low"))
    rows = lowered.select(F.col(id_col), F.explode(_pieces(F.col("__low"))).alias("p"))
    counted = rows.groupBy(id_col, "p.piece").agg(F.sum("p.w").alias("w"))
    # One digest gives bucket and parity.
    code = md5_mod(F.col("piece"), 2 * dimension)
    placed = counted.select(id_col, (code % dimension).alias("idx"), F.when(code % 2 == 0, F.col("w")).otherwise(-F.col("w")).alias("w"))
    full = placed.groupBy(id_col, "idx").agg(F.sum("w").alias("weight"))
    unit = texts.where(blank).select(F.col(id_col), F.lit(0).alias("idx"), F.lit(100).cast("bigint").alias("weight"))
    return full.unionByName(unit).where("weight <> 0")


def hash_embeddings(texts: DataFrame, id_col: str, text_col: str, dimension: int = 1536) -> DataFrame:
    """Dense unit vectors: the id column, vector array<float>.

    Lists of one text hold at most ``dimension`` entries.
    """
    w = hash_weights(texts, id_col, text_col, dimension)
    packed = w.groupBy(id_col).agg(F.collect_list("idx").alias("idx"), F.collect_list("weight").alias("weight"))
    id_type = texts.schema[id_col].dataType.simpleString()

    def dense(batches):
        # Built-in expressions can only fill an array by searching it once for each place.
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                idx, weight = some.column("idx"), some.column("weight")
                row = pc.list_parent_indices(idx).to_numpy()
                out = np.zeros((some.num_rows, dimension))
                out[row, idx.flatten().to_numpy()] = weight.flatten().to_numpy()
                out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
                flat = pa.array(out.astype(np.float32).ravel())
                ends = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * dimension)
                yield pa.RecordBatch.from_arrays([some.column(id_col), pa.ListArray.from_arrays(ends, flat)], [id_col, "vector"])

    return packed.mapInArrow(dense, f"`{id_col}` {id_type}, vector array<float>")


def point_id(col: Column) -> Column:
    """The name-based UUID (version 5) of a string."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(col, "UTF-8"))), 1, 32)
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Points of chunks: point_id, vector and the payload columns, kept flat so that filters on
    them reach the scan. vectors: (chunk_id, vector)."""
    m = F.col("metadata")
    own = chunks.select(
        point_id(F.col("chunk_id")).alias("point_id"),
        "chunk_id",
        "document_id",
        "text",
        "index",
        F.coalesce(m["title"], F.lit("")).alias("title"),
        F.coalesce(m["department"], F.lit("General")).alias("department"),
        F.coalesce(m["version"], F.lit("1.0")).alias("version"),
        F.coalesce(m["section_title"], F.lit("")).alias("section_title"),
        F.coalesce(m["section_path"], F.lit("")).alias("section_path"),
        F.coalesce(m["access_tier"], F.lit("Internal")).alias("access_tier"),
        F.coalesce(m["entity_hints"], F.array().cast("array<string>")).alias("entity_hints"),
    )
    return own.join(vectors, "chunk_id")


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points after an upsert: the new ones, and the old ones that none of them replaces."""
    fresh = new.dropDuplicates(["point_id"])
    return old.join(fresh.select("point_id"), "point_id", "left_anti").unionByName(fresh)


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last delivery of each chunk of both tables."""
    return latest(old.unionByName(new), ["chunk_id"], ["ingested_at"])


def dot(x: Column, y: Column) -> Column:
    """Sum of products of two arrays in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is a null vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def filtered(point_table: DataFrame, filters: dict) -> DataFrame:
    """Rows equal to all filters; null values filter nothing, list columns must contain the value."""
    for name, value in filters.items():
        if value is None:
            continue
        is_list = point_table.schema[name].dataType.simpleString().startswith("array")
        point_table = point_table.where(F.array_contains(name, value) if is_list else F.col(name) == F.lit(value))
    return point_table


def search(point_table: DataFrame, vector: list[float], id_col: str, vector_col: str, top_k: int = 5, filters: dict | None = None) -> DataFrame:
    """The ``top_k`` most similar rows with rank and score; filters come first, ties go by id.

    One partial top-k in each partition and one merge (TakeOrderedAndProject).
    """
    query = F.array(*[F.lit(float(v)) for v in vector])
    rows = filtered(point_table, filters or {}).withColumn("score", cosine(F.col(vector_col), query)).where("score is not null")
    best = rows.orderBy(F.desc("score"), id_col).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


#: Scores of this many (query, row) pairs are held at once in a task.
SCORES = 4_000_000


def check_dimension(point_table: DataFrame, vector_col: str, dimension: int) -> DataFrame:
    """``point_table`` unchanged; a vector of another length ends the query with an error. Null vectors pass."""
    n = F.size(vector_col)
    wrong = F.raise_error(F.concat(F.lit(f"{vector_col}: expected {dimension} dimensions, found "), n.cast("string"))).cast("boolean")
    return point_table.where(F.when(F.col(vector_col).isNull() | (n == dimension), F.lit(True)).otherwise(wrong))


def _matrix(column) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((rows * rows).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / size[:, None], size > 0


def search_batch(queries: DataFrame, query_id: str, query_vector: str, point_table: DataFrame, id_col: str, vector_col: str, top_k: int = 5, block: int = BROADCAST_QUERIES, filters: str | None = None) -> DataFrame:
    """query_id, rank, the id column, score: the ``top_k`` rows for each query.

    Exact: queries go out in blocks of at most ``block`` vectors (so that what is broadcast is
    bounded), and each block meets every row once, as products of matrices with a partial top-k
    in each batch. Ties go by id; scores are compared to 12 digits. Null vectors and those of
    length 0 find nothing and are not found.

    filters: a column map<string,string> of the queries; a row must equal all its values in the
    columns named (list columns must hold them); null values and maps filter nothing.
    """
    own = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"), *([F.col(filters).alias("f")] if filters else [])).where("v is not null")
    own = cut(own.withColumn("b", F.xxhash64("q")))
    blocks = max(1, -(-own.count() // block))
    named = sorted({r["k"] for r in own.select(F.explode(F.map_keys("f")).alias("k")).distinct().collect()} & set(point_table.columns)) if filters else []
    lists = {c: point_table.schema[c].dataType.simpleString().startswith("array") for c in named}
    rows = point_table.select(F.col(id_col).alias("p"), F.col(vector_col).alias("w"), *[F.col(c).cast("array<string>" if lists[c] else "string").alias(f"f_{c}") for c in named]).where("w is not null")
    kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((own, "q"), (rows, "p"))}
    context = queries.sparkSession.sparkContext
    out = None
    for number in range(blocks):
        asked = own.where(F.pmod("b", F.lit(blocks)) == number).toArrow()
        if not asked.num_rows:
            continue
        wanted = {}
        for c in named:
            values = [dict(x or []).get(c) for x in asked.column("f").to_pylist()]
            codes = {x: i for i, x in enumerate(sorted({x for x in values if x is not None}))}
            wanted[c] = (codes, np.array([codes.get(x, -1) for x in values]))
        sent = context.broadcast((asked.column("q").combine_chunks(), _matrix(asked.column("v").combine_chunks()).astype(np.float32), wanted))
        found = rows.mapInArrow(_best_of(sent, top_k, lists), f"q {kinds['q']}, p {kinds['p']}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(F.lit(None).cast(kinds["q"]).alias("q"), "p", F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k).select(F.col("q").alias(query_id), "rank", F.col("p").alias(id_col), "score")


def _best_of(sent, top_k: int, lists: dict[str, bool]):
    def run(batches):
        ids, vectors, wanted = sent.value
        asked, good = _unit(vectors.astype(np.float64))
        step = max(1, SCORES // len(asked))
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("p", "ascending")]))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                own, fine = _unit(_matrix(some.column("w")))
                score = np.round(asked @ own.T, 12)
                score[~good] = -np.inf
                score[:, ~fine] = -np.inf
                for c, (codes, value) in wanted.items():
                    said = some.column(f"f_{c}").to_pylist()
                    holds = np.zeros((len(codes) + 1, len(said)), bool)
                    holds[-1] = True
                    for row, x in enumerate(said):
                        for y in (x or []) if lists[c] else [x]:
                            if y in codes:
                                holds[codes[y], row] = True
                    score[~holds[value]] = -np.inf
                if some.num_rows > top_k:
                    least = np.partition(score, -top_k, axis=1)[:, -top_k]
                    q, p = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                    # Of ties at the end the lowest ids are kept.
                    order = np.lexsort((p, -score[q, p], q))
                    q, p = q[order], p[order]
                    first = np.searchsorted(q, q)
                    keep = np.arange(len(q)) - first < top_k
                    q, p = q[keep], p[keep]
                else:
                    q, p = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), some.column("p").take(pa.array(p)), pa.array(score[q, p])], ["q", "p", "score"])

    return run


def retrieve(questions: DataFrame, point_table: DataFrame, top_k: int = 5, dimension: int = 1536, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank, the id column, score of the ``top_k`` points nearest to each question.

    questions: query_id, query and, where wanted, document_id, access_tier and filters
    (map<string,string>, which override the two). Blank and null questions find nothing, empty and
    null filter values filter nothing. Points of another dimension are an error.
    """
    own = questions.withColumn("said", strip(F.coalesce("query", F.lit("")))).where("said <> ''")
    named = [c for c in ("document_id", "access_tier") if c in questions.columns]
    extra = F.map_entries(F.coalesce("filters", F.create_map().cast("map<string,string>"))) if "filters" in questions.columns else F.array().cast("array<struct<key:string,value:string>>")
    plain = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in named]).cast("array<struct<key:string,value:string>>")
    left = F.filter(plain, lambda x: ~F.exists(F.col("extra"), lambda y: y["key"] == x["key"]))
    set_ones = F.filter(F.concat(left, "extra"), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    asked = own.withColumn("extra", extra).select("query_id", "said", F.map_from_entries(set_ones).alias("f"))
    vec = hash_embeddings(asked, "query_id", "said", dimension).withColumnRenamed("vector", "v").join(asked.select("query_id", "f"), "query_id")
    return search_batch(vec, "query_id", "v", check_dimension(point_table, vector_col, dimension), id_col, vector_col, top_k, filters="f")


# ---- inverted-list index -------------------------------------------------------------------

#: Rows that the centroids are fitted on at most; every row is indexed.
INDEX_SAMPLE = 20_000
#: Queries of a list that meet a block of its rows at once.
QUERY_BLOCK = 20_000


def fit_lists(point_table: DataFrame, id_col: str, vector_col: str, lists: int = 64, sample: int = INDEX_SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centroids (unit vectors) of at most ``lists`` lists: spherical k-means on the at most ``sample``
    rows of the least hash of their id. A table without vectors has none."""
    rows = point_table.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("p"), F.col(vector_col).alias("w"))
    chosen = rows.orderBy(F.xxhash64("p"), "p").limit(sample).select("w").toArrow()
    if not chosen.num_rows:
        return np.empty((0, 0))
    own, fine = _unit(_matrix(chosen.column("w").combine_chunks()))
    own = own[fine]
    if not len(own):
        return np.empty((0, 0))
    centroids = own[np.linspace(0, len(own) - 1, min(lists, len(own))).astype(int)]
    for _ in range(rounds):
        nearest = (own @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, own)
        size = np.sqrt((sums * sums).sum(1))
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centroids)
    return centroids


def _nearest(df: DataFrame, vector_col: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """``df`` with ``list``, one row for each of the ``probes`` nearest centroids."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)
    shape = df.limit(0).selectExpr("*", "CAST(0 AS INT) AS list").schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                own, fine = _unit(_matrix(some.column(vector_col)))
                near = np.argsort(-(own[fine] @ sent.value.T), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.flatnonzero(fine), near.shape[1])
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(near.ravel(), pa.int32())], [*some.schema.names, "list"])

    return df.where(F.col(vector_col).isNotNull()).mapInArrow(run, shape)


def build_index(point_table: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray, rows_per_block: int = 50_000) -> DataFrame:
    """The index: (p, w, list, block) of every row with a vector of some length. A list of more rows falls
    into blocks by a hash of the id, so that no task holds a whole hot list."""
    placed = cut(_nearest(point_table.select(F.col(id_col).alias("p"), F.col(vector_col).alias("w")), "w", centroids, 1))
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("blocks"))
    # One row for each list.
    return placed.join(F.broadcast(blocks), "list").select("p", "w", "list", F.pmod(F.xxhash64("p"), "blocks").cast("int").alias("block"), "blocks")


def search_index(queries: DataFrame, query_id: str, query_vector: str, index: DataFrame, centroids: np.ndarray, id_col: str, top_k: int = 5, probes: int = 8) -> DataFrame:
    """query_id, rank, the id column, score: the ``top_k`` rows of the ``probes`` lists nearest to each query.

    Approximate: what lies in other lists is missed; with as many probes as lists it equals
    ``search_batch``, the exact way. Queries and rows meet by list and block, so a query reads
    probes / lists of all rows.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    kinds = {"q": asked.schema["q"].dataType.simpleString(), "p": index.schema["p"].dataType.simpleString()}
    near = _nearest(asked, "v", centroids, probes) if len(centroids) else asked.limit(0).selectExpr("*", "CAST(0 AS INT) AS list")
    near = cut(near)
    # Both sides of a list fall into blocks, and each block of queries meets each block of rows.
    asks = near.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qblocks"))
    sizes = index.select("list", "blocks").distinct().join(asks, "list")
    wanted = near.join(F.broadcast(sizes), "list").select("q", "v", "list", F.pmod(F.xxhash64("q"), "qblocks").cast("int").alias("qblock"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = index.join(F.broadcast(asks), "list").select("p", "w", "list", "block", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"))

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.table({"q": asked.column("q").slice(0, 0), "p": rows.column("p").slice(0, 0), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not rows.num_rows:
            return none
        rows = rows.sort_by("p")
        own, fine = _unit(_matrix(rows.column("w").combine_chunks()))
        out = [none]
        step = max(1, SCORES // rows.num_rows)
        for at in range(0, asked.num_rows, step):
            some = asked.slice(at, step)
            unit, good = _unit(_matrix(some.column("v").combine_chunks()))
            score = np.round(unit @ own.T, 12)
            score[~good] = -np.inf
            score[:, ~fine] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :top_k]
            q = np.repeat(np.arange(some.num_rows), best.shape[1])
            p = best.ravel()
            keep = score[q, p] > -np.inf
            out.append(pa.table({"q": some.column("q").take(pa.array(q[keep])), "p": rows.column("p").take(pa.array(p[keep])), "score": score[q, p][keep]}))
        return pa.concat_tables(out)

    keys = ["list", "block", "qblock"]
    found = wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, f"q {kinds['q']}, p {kinds['p']}, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select(F.col("q").alias(query_id), "rank", F.col("p").alias(id_col), "score")
