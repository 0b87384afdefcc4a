"""Ranked search: vectors, weighted terms, exact symbols, and their fusion, for a table of questions.

Vector and term scores are exact. Questions and entities of a repository are cut into blocks of bounded size; each
pair of blocks is scored in one task with a matrix product or a small inverted index, and only the best `k` rows per
question leave the task. No pair of a question and an entity is ever shuffled, and a repository holding most of the
data is spread over many blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import constants as C
from codestrata.functions.paths import is_generated_file, is_test_file
from codestrata.functions.stems import stems
from codestrata.functions.text import identifier_words

from .ranking import cut, place, small, top_k, union_all

ENTITY_BLOCK = 8192
TERM_BLOCK = 2048
QUESTION_BLOCK = 1024
# Vectors: blocks of a repository's entities and questions, more only where a block would pass BLOCK_BYTES; rows multiplied at once.
ENTITY_BLOCKS, QUESTION_BLOCKS, BLOCK_BYTES, ASKED_ROWS = 4, 16, 96 << 20, 512
# Tiles of a repository, more only where a block would pass BLOCK_BYTES or a tile TILE_PAIRS; bytes of a posting in a task.
TILES, TILE_PAIRS, POSTING_BYTES = 64, 1 << 30, 48
DIGITS = 6
NAME_GRAM = 3


def with_blocks(df: DataFrame, id_col: str, rows_per_block: int, block: str, blocks: str, few: int | None = None) -> DataFrame:
    """Adds a hash block of bounded expected size to every row, and the number of blocks of its repository.

    With `few`, for rows with an `embedding`, there are no more blocks than that, unless their vectors would pass BLOCK_BYTES. The repository is tied to the row's id first: a constant one would be moved out of the joins, which then have no key.
    """
    df = _tied(df, id_col)
    number, width = F.ceil(F.col("_n") / rows_per_block), F.lit(0)
    if few is not None:
        width = F.max(F.size("embedding"))
        number = F.greatest(F.least(number, F.lit(few)), F.ceil(F.col("_n") * F.col("_width") * 4 / BLOCK_BYTES))
    counts = df.groupBy("repository_id").agg(F.approx_count_distinct(id_col).alias("_n"), width.alias("_width"))
    counts = small(counts.select("repository_id", F.greatest(number, F.lit(1)).cast("int").alias(blocks)))
    return df.join(counts, "repository_id").withColumn(block, _block_of(id_col, blocks))


def _tied(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("repository_id", F.concat("repository_id", F.substring(F.col(id_col).cast("string"), 1, 0)))


def _block_of(id_col: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.col(blocks)).cast("int")


def tile_numbers(asked: DataFrame, held: DataFrame, row_bytes: Column, question_block: int | None = None, entity_block: int | None = None,
                 rows: int = ENTITY_BLOCK) -> DataFrame:
    """(repository_id, qbs, ebs): blocks of questions and of entities, for repositories that have both.

    A row goes to all blocks of the other side. Of the ways to cut a repository into as many tiles as it needs, the one that moves the
    fewest bytes has blocks of both sides alike: the smaller table goes to many blocks, the larger to few. A block given in rows is kept.
    """
    sizes = lambda df, id_col, n, size: df.groupBy("repository_id").agg(
        F.approx_count_distinct(id_col).alias(n), F.greatest(F.sum(row_bytes), F.lit(1)).alias(size))
    both = sizes(asked, "question_id", "_asked", "_asked_bytes").join(sizes(held, "id", "_held", "_held_bytes"), "repository_id")
    of = lambda n, block: F.greatest(F.ceil(F.col(n) / block), F.lit(1))
    tile_count = F.greatest(F.least(of("_asked", QUESTION_BLOCK) * of("_held", rows), F.lit(TILES)), F.ceil(F.col("_asked") * F.col("_held") / TILE_PAIRS))
    balanced = F.round(F.sqrt(tile_count * F.col("_asked_bytes") / F.col("_held_bytes")))
    both = both.withColumn("_t", tile_count).withColumn("_q", F.greatest(F.least(balanced, F.col("_t")), F.lit(1)))
    qbs = of("_asked", question_block) if question_block else F.greatest(F.col("_q"), of("_asked_bytes", BLOCK_BYTES))
    ebs = of("_held", entity_block) if entity_block else F.greatest(F.ceil(F.col("_t") / F.col("_q")), of("_held_bytes", BLOCK_BYTES))
    return both.select("repository_id", qbs.cast("int").alias("qbs"), ebs.cast("int").alias("ebs"))


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


TILE = ["repository_id", "eb", "qb"]


def tiles(df: DataFrame):
    """Groups rows by tile, shuffled by all three keys.

    Without the explicit shuffle Spark may keep a placement by repository alone, which satisfies the grouping but puts
    all tiles of a repository into one task. New column identities let two sides of one table be co-grouped.
    """
    return place(df.select(*[F.col(c).alias(c) for c in df.columns]), *TILE).groupBy(*TILE)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best `k` scores, larger first, smaller id first among equals."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _hits(repository: str, questions: list, picks: list, ids: np.ndarray, scores: list) -> pa.Table:
    sizes = [len(p) for p in picks]
    return pa.table({
        "repository_id": pa.array([repository] * sum(sizes), pa.string()),
        "question_id": pa.array(np.repeat(np.asarray(questions, dtype="int64"), sizes) if sizes else [], pa.int64()),
        "id": pa.array(ids[np.concatenate(picks)] if sum(sizes) else [], pa.int64()),
        "score": pa.array(np.concatenate(scores) if sum(sizes) else [], pa.float64()),
    })


HITS = "repository_id string, question_id long, id long, score double"


def unit_rows(table: pa.Table) -> np.ndarray:
    """The vectors of a table as a matrix with rows of length 1; a zero vector stays zero."""
    column = table.column("embedding").combine_chunks()
    rows = np.asarray(column.flatten(), dtype="float64").reshape(len(table), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


class BestRows:
    """The best `k` (score, id) of each of some questions, larger scores first, smaller ids first among equals."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty((questions, 0)), np.empty((questions, 0), "int64")

    def bar(self, of: np.ndarray) -> np.ndarray:
        """The k-th score so far of the questions at `of`."""
        return self.scores[of, -1] if self.scores.shape[1] == self.k else np.full(len(of), -np.inf)

    def add(self, of: np.ndarray, similar: np.ndarray, ids: np.ndarray) -> None:
        """Merges `similar`, a row for each question at `of` and a column for each id."""
        bar = self.bar(of)
        if similar.shape[1] > self.k and (open_rows := np.flatnonzero(np.isneginf(bar))).size:
            at = similar.shape[1] - self.k
            bar[open_rows] = np.partition(similar[open_rows], at, axis=1)[:, at]
        row, column = np.nonzero(similar >= (bar - 10.0 ** -DIGITS)[:, None])
        if not len(row):
            return
        held = self.scores.shape[1]
        row = np.concatenate([row, np.repeat(np.arange(len(of)), held)])
        score = np.concatenate([np.round(similar[row[:len(column)], column], DIGITS), self.scores[of].ravel()])
        new = np.concatenate([ids[column], self.ids[of].ravel()])
        order = np.lexsort((new, -score, row))
        row, score, new = row[order], score[order], new[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        width = min(self.k, max(held, int(place.max()) + 1))
        if width > held:  # -inf stands for no row
            self.scores = np.pad(self.scores, ((0, 0), (0, width - held)), constant_values=-np.inf)
            self.ids = np.pad(self.ids, ((0, 0), (0, width - held)))
        scores, found = np.full((len(of), width), -np.inf), np.zeros((len(of), width), "int64")
        scores[row[keep], place[keep]], found[row[keep], place[keep]] = score[keep], new[keep]
        self.scores[of], self.ids[of] = scores, found

    def hits(self, repository: str, questions: np.ndarray) -> pa.Table:
        row, column = np.nonzero(self.scores > -np.inf)
        return pa.table({
            "repository_id": pa.array([repository] * len(row), pa.string()), "question_id": pa.array(questions[row], pa.int64()),
            "id": pa.array(self.ids[row, column], pa.int64()), "score": pa.array(self.scores[row, column], pa.float64()),
        })


NO_HITS = pa.table({"repository_id": pa.array([], pa.string()), "question_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                    "score": pa.array([], pa.float64())})


def score_vectors(k: int):
    """Scores a tile of entities with vectors by a tile of questions: the best `k` of each question.

    Some rows are multiplied at a time, so a task holds its two blocks and a bounded product.
    """

    def score(held_rows: pa.Table, asked_rows: pa.Table) -> pa.Table:
        if not len(held_rows) or not len(asked_rows):
            return NO_HITS
        ids, held = held_rows.column("id").to_numpy(), unit_rows(held_rows)
        questions, asked = asked_rows.column("question_id").to_numpy(), unit_rows(asked_rows)
        found = []
        for start in range(0, len(questions), ASKED_ROWS):
            part = asked[start:start + ASKED_ROWS]
            best, every = BestRows(len(part), k), np.arange(len(part))
            for at in range(0, len(ids), ENTITY_BLOCK):
                best.add(every, part @ held[at:at + ENTITY_BLOCK].T, ids[at:at + ENTITY_BLOCK])
            found.append(best.hits(held_rows.column("repository_id")[0].as_py(), questions[start:start + ASKED_ROWS]))
        return pa.concat_tables(found)

    return score


def questions_in_blocks(questions: DataFrame, rows: int | None = None) -> DataFrame:
    """Questions with vectors in blocks of `rows`, or in few blocks."""
    return with_blocks(questions.select("repository_id", "question_id", "embedding"), "question_id", rows or QUESTION_BLOCK, "qb", "qbs",
                       None if rows else QUESTION_BLOCKS)


def vector_top_k(questions: DataFrame, entities: DataFrame, k: int = C.SEARCH_DEPTH, entity_block: int | None = None,
                 question_block: int | None = None) -> DataFrame:
    """The `k` entities most similar (cosine) to each question, within the question's repository.

    A row goes to every block of the other side: see `tile_numbers`. Both tables are read twice, so vectors that are made on the way
    should be stored.

    questions(question_id, repository_id, embedding), entities(repository_id, id, embedding) →
    (repository_id, question_id, id, score, rank). Only repositories that are asked about are read past the first join.
    """
    asked = _tied(questions.select("repository_id", "question_id", "embedding"), "question_id")
    held = _tied(entities.select("repository_id", "id", "embedding"), "id")
    numbers = small(tile_numbers(asked, held, F.size("embedding") * 4, question_block, entity_block))
    left = held.join(numbers, "repository_id").select(
        "repository_id", _block_of("id", "ebs").alias("eb"), _every("qbs").alias("qb"), "id", "embedding"
    )
    right = asked.join(numbers, "repository_id").select(
        "repository_id", _every("ebs").alias("eb"), _block_of("question_id", "qbs").alias("qb"), "question_id", "embedding"
    )

    hits = tiles(left).cogroup(tiles(right)).applyInArrow(score_vectors(k), HITS)
    return top_k(hits, ["repository_id", "question_id"], [F.desc("score"), F.asc("id")], k)


def nearest(entities: DataFrame, vector: Column, k: int = C.SEARCH_DEPTH) -> DataFrame:
    """One question: plain expression and a top-k sort, no shuffle of the table."""
    from codestrata.functions.vectors import cosine

    scored = entities.select("id", F.round(cosine(F.col("embedding"), vector), DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)


def postings(entities: DataFrame, stem: str | None = C.TEXT_LANGUAGE) -> DataFrame:
    """Inverted index rows (repository_id, id, term, weight, tf): name 1.0, path 0.4, content 0.1 per occurrence.

    `weight` is the sum over occurrences. Entities are placed by id before their words are spread: the text crosses the
    network once, and the words of an entity are counted where they are. Terms are stems of the language `stem`, without its
    stop words; None keeps words as they are. Only an entity's distinct words are stemmed, in its own place.
    """
    def words(text: Column, weight: float) -> Column:
        found = F.regexp_extract_all(F.lower(identifier_words(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
        return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    tokens = F.concat(
        words(F.col("symbol_name"), C.NAME_WEIGHT), words(F.col("file_path"), C.PATH_WEIGHT),
        words(F.col("content"), C.CONTENT_WEIGHT),
    )
    counted = (
        place(entities.select("repository_id", "id", "symbol_name", "file_path", "content"), "repository_id", "id")
        .select("repository_id", "id", F.explode(tokens).alias("t"))
        .groupBy("repository_id", "id", F.col("t.term").alias("term"))
        .agg(F.round(F.sum("t.weight"), DIGITS).alias("weight"), F.count("*").alias("tf"))
    )
    if stem is None:
        return counted
    return (
        counted.withColumn("term", stems(F.col("term"), stem)).where(F.col("term").isNotNull()).groupBy("repository_id", "id", "term")
        .agg(F.round(F.sum("weight"), DIGITS).alias("weight"), F.sum("tf").alias("tf"))
    )


def explode_array(df: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    """Explodes a costly array expression once.

    A plain explode makes the optimizer filter on the size of the array first, which repeats the whole expression.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def search_terms(questions: DataFrame, stem: str | None = C.TEXT_LANGUAGE) -> DataFrame:
    """(repository_id, question_id, term) as matched in the index: only letters and digits of each keyword, stemmed like the index."""
    stripped = F.transform("terms", lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    kept = F.array_distinct(F.filter(stripped, lambda t: t != ""))
    asked = explode_array(questions, kept, "term", "repository_id", "question_id")
    if stem is None:
        return asked
    return asked.withColumn("term", stems(F.col("term"), stem)).where(F.col("term").isNotNull()).distinct()


def score_terms(k: int):
    """Scores a tile of postings by a tile of questions' terms: the best `k` of each question."""

    def score(held_rows: pa.Table, asked_rows: pa.Table) -> pa.Table:
        if not len(held_rows) or not len(asked_rows):
            return _hits("", [], [], np.empty(0, "int64"), [])
        words = held_rows.column("term").combine_chunks().dictionary_encode()
        held_term, terms = words.indices.to_numpy(), words.dictionary
        ids, held_id = np.unique(held_rows.column("id").to_numpy(), return_inverse=True)
        order = np.argsort(held_term, kind="stable")
        held_id, weight = held_id[order], held_rows.column("weight").to_numpy()[order]
        starts = np.searchsorted(held_term[order], np.arange(len(terms) + 1))
        asked_ids, asked_id = np.unique(asked_rows.column("question_id").to_numpy(), return_inverse=True)
        asked_term = pc.fill_null(pc.index_in(asked_rows.column("term"), value_set=terms), -1).to_numpy()  # -1: not in this tile
        by_question = np.argsort(asked_id, kind="stable")
        bounds = np.searchsorted(asked_id[by_question], np.arange(len(asked_ids) + 1))
        picks, scores = [], []
        for q in range(len(asked_ids)):
            here = asked_term[by_question[bounds[q]:bounds[q + 1]]]
            here = here[here >= 0]
            total = np.zeros(len(ids) if len(here) else 0)
            for t in here:
                total[held_id[starts[t]:starts[t + 1]]] += weight[starts[t]:starts[t + 1]]
            total = np.round(total, DIGITS)
            found = np.flatnonzero(total > 0)
            best = found[_best(total[found], ids[found], k)]
            picks.append(best)
            scores.append(total[best])
        return _hits(held_rows.column("repository_id")[0].as_py(), asked_ids.tolist(), picks, ids, scores)

    return score


def term_top_k(questions: DataFrame, index: DataFrame, k: int = C.SEARCH_DEPTH, entity_block: int | None = None,
               question_block: int | None = None, stem: str | None = C.TEXT_LANGUAGE) -> DataFrame:
    """The `k` entities with the largest summed weight of a question's terms (any term may match).

    questions(question_id, repository_id, terms), index from `postings` with the same `stem` → (repository_id, question_id, id,
    score, rank).
    The index is first cut to terms that are asked for; what is left is cut into tiles by `tile_numbers`.
    """
    # stored: both are used for the counts and for the tiles
    asked = cut(_tied(search_terms(questions, stem), "question_id"))
    wanted = small(asked.select("repository_id", "term").distinct())
    held = cut(_tied(index.select("repository_id", "id", "term", "weight").join(wanted, ["repository_id", "term"], "left_semi"), "id"))
    numbers = small(tile_numbers(asked, held, F.lit(POSTING_BYTES), question_block, entity_block, TERM_BLOCK))
    left = held.join(numbers, "repository_id").select(
        "repository_id", _block_of("id", "ebs").alias("eb"), _every("qbs").alias("qb"), "id", "term", "weight")
    right = asked.join(numbers, "repository_id").select(
        "repository_id", _every("ebs").alias("eb"), _block_of("question_id", "qbs").alias("qb"), "question_id", "term")

    hits = tiles(left).cogroup(tiles(right)).applyInArrow(score_terms(k), HITS)
    return top_k(hits, ["repository_id", "question_id"], [F.desc("score"), F.asc("id")], k)


def symbol_matches(questions: DataFrame, entities: DataFrame, k: int = C.SYMBOL_DEPTH) -> DataFrame:
    """Entities whose lower-case name is one of a question's candidates: (repository_id, question_id, id, name, rank).

    The first `k` by id of each name are enough to give the first `k` by id of any set of names, so a name shared by
    very many entities is cut before the join and the result stays exact.
    """
    wanted = explode_array(questions, F.col("candidates"), "name", "repository_id", "question_id")
    named = entities.select("repository_id", "id", F.lower("symbol_name").alias("name"))
    asked_names = wanted.select("repository_id", "name").distinct()
    named = named.join(asked_names, ["repository_id", "name"], "left_semi")
    named = top_k(named, ["repository_id", "name"], [F.asc("id")], k, "_r").drop("_r")
    return top_k(wanted.join(named, ["repository_id", "name"]), ["repository_id", "question_id"], [F.asc("id")], k)


def fuse(semantic: DataFrame, keyword: DataFrame, symbol: DataFrame, k: int = C.FUSED_DEPTH) -> DataFrame:
    """Reciprocal rank fusion of three ranked lists.

    semantic and keyword: (repository_id, question_id, id, score, rank from 1); symbol: (…, id, is_identifier).
    Result: (repository_id, question_id, id, score, similarity, reasons, rank).
    """
    key = ["repository_id", "question_id", "id"]
    reciprocal = lambda weight: F.lit(weight) / (F.lit(C.RRF_K) + F.col("rank") - 1)
    none = F.lit(None).cast("double")
    bonus = F.when(F.col("is_identifier"), C.IDENTIFIER_BONUS).otherwise(C.WORD_BONUS) / C.RRF_K
    lists = union_all(
        semantic.select(*key, reciprocal(1.0).alias("part"), F.lit("semantic").alias("reason"), F.col("score").alias("similarity")),
        keyword.select(*key, reciprocal(C.KEYWORD_WEIGHT).alias("part"), F.lit("keyword").alias("reason"), none.alias("similarity")),
        symbol.select(*key, bonus.alias("part"), F.lit("symbol").alias("reason"), none.alias("similarity")),
    )
    in_list = lambda name: F.bool_or(F.col("reason") == name)
    fused = lists.groupBy(*key).agg(
        F.round(F.sum("part"), 9).alias("score"), F.max("similarity").alias("similarity"),
        F.array_compact(F.array(*[F.when(in_list(r), F.lit(r)) for r in ("semantic", "keyword", "symbol")])).alias("reasons"),
    )
    return top_k(fused, ["repository_id", "question_id"], [F.desc("score"), F.asc("id")], k)


def rescore(hits: DataFrame) -> Column:
    """Score after metadata: needs file_path, symbol_type, route, query_type and about_tests next to the fused score."""
    kind, symbol_type = F.col("query_type"), F.col("symbol_type")
    factor = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(1.0)
    return F.round(
        F.col("score")
        * factor(~F.col("about_tests") & is_test_file(F.col("file_path")), 0.5)
        * factor(is_generated_file(F.col("file_path")), 0.5)
        * factor((kind != "architecture") & symbol_type.isin("doc", "config"), 0.6)
        * factor((kind == "architecture") & symbol_type.isin("doc", "module"), 1.3)
        * factor((kind == "routes") & (F.coalesce(F.col("route"), F.lit("")) != ""), 1.5)
        * factor(symbol_type == "chunk", 0.8),
        9,
    )


def rescored_top(fused: DataFrame, questions: DataFrame, entities: DataFrame, limit: int = 10, architecture_limit: int = 14) -> DataFrame:
    """Re-scores fused hits with entity metadata and keeps the best of each question.

    questions(question_id, repository_id, query_type, about_tests).
    """
    facts = entities.select("repository_id", "id", "file_path", "symbol_type", "symbol_name", "route")
    asked = questions.select("repository_id", "question_id", "query_type", "about_tests")
    joined = fused.drop("rank").join(facts, ["repository_id", "id"]).join(asked, ["repository_id", "question_id"])
    scored = joined.withColumn("score", rescore(joined))
    best = top_k(scored, ["repository_id", "question_id"], [F.desc("score"), F.asc("id")], max(limit, architecture_limit))
    return best.where(F.col("rank") <= F.when(F.col("query_type") == "architecture", architecture_limit).otherwise(limit))


def find_symbols(entities: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Substring search on names of one or more repositories: exact name first, then shorter names."""
    name = F.lower("symbol_name")
    hits = entities.where(~F.col("symbol_type").isin(*C.NON_OUTLINE_TYPES) & F.contains(name, F.lower(F.lit(needle))))
    order = [F.desc(name == F.lower(F.lit(needle))), F.asc(F.length("symbol_name")), F.asc("id")]
    return top_k(hits.select("repository_id", "id", "symbol_name", "symbol_type", "file_path", "route"), ["repository_id"], order, limit)


def _outline_names(entities: DataFrame) -> DataFrame:
    return entities.where(~F.col("symbol_type").isin(*C.NON_OUTLINE_TYPES) & (F.col("symbol_name") != ""))


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of `size` letters of a text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(text, i, size)), lambda g: F.length(g) == size))


def name_grams(entities: DataFrame) -> DataFrame:
    """Index of names (repository_id, gram, symbol_name): every run of one to three lower-case letters of every distinct name."""
    names = _outline_names(entities).select("repository_id", "symbol_name").distinct()
    name = F.lower("symbol_name")
    every = F.concat(*[_grams(name, F.lit(n)) for n in range(1, NAME_GRAM + 1)])
    return explode_array(names, every, "gram", "repository_id", "symbol_name")


def find_symbols_of(needles: DataFrame, entities: DataFrame, grams: DataFrame, limit: int = 50) -> DataFrame:
    """Substring search for a table of needles(repository_id, needle_id, needle): exact names first, then shorter ones.

    (repository_id, needle_id, id, symbol_name, symbol_type, file_path, route, rank), like `find_symbols` for each needle,
    without regard to case and to blanks around the needle; an empty needle finds nothing.  `grams` as `name_grams` gives it.
    A needle is looked up by the gram of its own that the fewest names of the repository hold; names found so are compared.
    A needle of one or two letters is a gram itself.  Of a name that many entities share the first `limit` are enough.
    """
    asked = needles.select("repository_id", "needle_id", F.lower(F.trim("needle")).alias("needle")).where(F.col("needle") != "")
    wanted = cut(asked.select("repository_id", "needle").distinct())
    own = cut(explode_array(wanted, _grams(F.col("needle"), F.least(F.length("needle"), F.lit(NAME_GRAM))), "gram", "repository_id", "needle"))
    asked_for = cut(grams.join(own.select("repository_id", "gram").distinct(), ["repository_id", "gram"], "left_semi"))
    counts = asked_for.groupBy("repository_id", "gram").agg(F.count("*").alias("n"))
    counted = own.join(counts, ["repository_id", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("repository_id", "needle").agg(F.min(F.struct("n", "gram")).alias("r")).select("repository_id", "needle", "r.gram")
    matches = rarest.join(asked_for, ["repository_id", "gram"]).where(F.contains(F.lower("symbol_name"), F.col("needle"))).select("repository_id", "needle", "symbol_name")
    held = _outline_names(entities).select("repository_id", "id", "symbol_name", "symbol_type", "file_path", "route")
    held = held.join(matches.select("repository_id", "symbol_name").distinct(), ["repository_id", "symbol_name"], "left_semi")
    held = top_k(held, ["repository_id", "symbol_name"], [F.asc("id")], limit, "_r").drop("_r")
    order = [F.desc(F.lower("symbol_name") == F.col("needle")), F.asc(F.length("symbol_name")), F.asc("id")]
    found = top_k(matches.join(held, ["repository_id", "symbol_name"]), ["repository_id", "needle"], order, limit)
    return asked.join(found, ["repository_id", "needle"]).select("repository_id", "needle_id", "id", "symbol_name", "symbol_type", "file_path", "route", "rank")


def route_index(entities: DataFrame, limit: int | None = None, by_place: bool = False) -> DataFrame:
    """Routed entities by route, or by file and line."""
    routed = entities.where(F.col("route").isNotNull()).select("repository_id", "id", "route", "file_path", "start_line", "symbol_name")
    order = [F.asc("file_path"), F.asc("start_line"), F.asc("id")] if by_place else [F.asc("route"), F.asc("id")]
    return routed.orderBy("repository_id", *order) if limit is None else top_k(routed, ["repository_id"], order, limit)
