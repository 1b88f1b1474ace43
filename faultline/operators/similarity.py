"""Similar incidents: one TF-IDF fit over all incidents, structured bonus, exact top k per incident.

Incidents with equal text and equal matched fields score equally against anything. They are folded into
one signature, so a flood of copies costs one comparison, and only the first rows of each
signature in the tie order are brought back. Words and terms are counted where the text is read; only vectors move.
Signatures are compared block by block: every block pairs a bounded number of query vectors with a bounded shard of
candidate vectors and returns its own top rows, so neither pairs of incidents nor whole groups are shuffled.
"""

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline import constants as C
from faultline.functions.text import empty_to_null
from faultline.operators.incidents import candidate_order, has_signal, signal_of
from faultline.session import spread, stage

QUERY_BLOCK = 32_768
CANDIDATE_SHARD = 32_768
TILE = 1024
CHUNK = 1024
# The start of the first chunk, while no scores are known.
FIRST_CHUNK = 16
# Least candidates that get groups of terms of their own; how many groups there are; which is tried first.
SEGMENT = 4096
LEVELS = (48, 96, 160, 256, 384)
FIRST_LEVEL = 3
# What scoring one pair costs, in groups of one pair's bound; by how much less it must be for a coarser level; width of a kind.
PAIR_COST = 8_000
COARSER = 4
KIND = 0.06
# Values that a field may have in a segment to be compared by columns of the product.
COLUMNS = 64
# Pairs scored at a time, and the share of a tile (one in so many) from which all of it is.
PICKED = 256
DENSE_SHARE = 16
# The share of a tile (one in so many) from which a finer level is tried at once.
RAISE_SHARE = 40
# Scores are rounded to 0.0001; single precision can be off by less than the margin.
HALF = 0.00005
MARGIN = 0.00003
# Pairs of the first round, by how much rounds grow, and about how many places are sampled to divide them.
ROUND_PAIRS = 1 << 33
ROUND_GROWTH = 3
SAMPLED = 4000
FREQUENT = 100_000
ASKED = "asked_"
TEXT_FIELDS = [
    "alert_name", "title", "description", "service_name", "severity", "source", "status", "raw_log", "notes",
]
PARSED_TEXT = ["log_level", "error_message", "exception_type", "status_code", "failure_type"]
MATCHED = [name for name, _ in C.BONUS]
PLACE = ["no_resolved", "resolved_at", "no_updated", "updated_at", "id"]
MATCHES = ["query_signature", "signature", "score"]


def _parsed(name: str, incidents: DataFrame) -> Column:
    return F.col(f"parsed_log.{name}") if "parsed_log" in incidents.columns else F.lit(None).cast("string")


def incident_text(incidents: DataFrame) -> Column:
    """All text fields joined by blanks; empty values and status code 0 are left out."""
    own = [empty_to_null(F.col(name)) for name in TEXT_FIELDS if name in incidents.columns]
    code = _parsed("status_code", incidents).cast("string")
    nested = [
        F.when(code != "0", code) if name == "status_code" else empty_to_null(_parsed(name, incidents))
        for name in PARSED_TEXT
    ]
    return F.concat_ws(" ", *own, *nested)


def tokenize(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.WORD), F.lit(0))


def remove_stop_words(words: Column, stop_words: Iterable[str]) -> Column:
    stop = sorted(set(stop_words))
    return F.filter(words, lambda word: ~word.isin(stop)) if stop else words


def ngrams_1_2(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1),
        F.slice(words, F.lit(2), F.size(words) - 1),
        lambda first, second: F.concat(first, F.lit(" "), second),
    )
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def signatures(incidents: DataFrame) -> DataFrame:
    """Incidents with their text, matched fields, place in the tie order and the hash of everything that decides a score."""
    resolved = (F.upper("status") == "RESOLVED") & empty_to_null(F.col("notes")).isNotNull()
    fields = {
        "service_name": F.col("service_name"),
        "alert_name": F.col("alert_name"),
        "failure_type": _parsed("failure_type", incidents),
        "exception_type": _parsed("exception_type", incidents),
        "status_code": F.nullif(_parsed("status_code", incidents).cast("string"), F.lit("0")),
    }
    decided = F.struct(
        incident_text(incidents).alias("text"),
        *[F.coalesce(value, F.lit("")).alias(name) for name, value in fields.items()],
        F.coalesce(resolved, F.lit(False)).alias("has_notes"),
    )
    keyed = incidents.withColumn("content", decided)
    return keyed.withColumn("signature", F.unhex(F.sha2(F.to_json("content"), 256)))


def document_words(keyed: DataFrame, stop_words: Iterable[str], *also: Column) -> DataFrame:
    """(id, signature, fields, words) of every incident; stored, so a text is hashed and split once and never shuffled."""
    words = remove_stop_words(tokenize(F.col("content.text")), stop_words)
    fields = [F.col(f"content.{name}") for name in (*MATCHED, "has_notes")]
    return stage(keyed.select("id", "signature", *also, *fields, words.alias("words")), "words")


def limit_vocabulary(words: DataFrame, size: int = C.VOCABULARY) -> DataFrame:
    """The most frequent words and pairs of the corpus, ties in term order.

    Counted level by level: a pair occurs at most as often as each of its words. So pairs with a word that occurs less often
    than the last of the `size` most frequent words cannot be among the terms, and only the others are shuffled.
    """
    col = F.col
    single = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    single = stage(single, "words-counted")
    top = single.orderBy(col("tf").desc()).limit(size).agg(F.min("tf").alias("tf"), F.count("*").alias("n")).first()
    bound = top["tf"] if top["n"] == size else 0
    frequent = single.filter(col("tf") >= bound)
    # Ties aside these are `size` words. They go to the pairs, which would otherwise be shuffled once per word.
    few = frequent.limit(FREQUENT + 1).count() <= FREQUENT
    following = F.slice("words", F.lit(2), F.size("words"))
    pair = F.zip_with("words", following, lambda first, second: F.struct(first.alias("first"), second.alias("second")))
    pairs = words.filter(F.size("words") > 1).select(F.explode(pair).alias("p")).select("p.*")
    for name in ("first", "second"):
        wanted = frequent.select(col("term").alias(name))
        pairs = pairs.join(F.broadcast(wanted) if few else wanted, name, "left_semi")
    double = pairs.groupBy("first", "second").agg(F.count("*").alias("tf")).filter(col("tf") >= bound)
    double = double.select(F.concat_ws(" ", "first", "second").alias("term"), "tf")
    return frequent.unionByName(double).orderBy(col("tf").desc(), "term").limit(size)


def document_terms(words: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with its terms' positions and counts, counted in place, and the (term, position) they refer to.

    The vocabulary has a fixed upper size; a position is the rank of a term in term order.
    """
    terms = sorted(row["term"] for row in vocabulary.select("term").collect())
    numbered = words.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, position int")
    if terms:
        counter = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="found")
        found = counter.transform(words.withColumn("grams", ngrams_1_2(F.col("words"))))
        counted = found.withColumn("found", F.unwrap_udt("found")).withColumns(
            {"positions": F.col("found.indices"), "counts": F.col("found.values").cast("array<int>")}
        ).drop("grams", "found")
    else:
        none = F.array().cast("array<int>")
        counted = words.withColumns({"positions": none, "counts": none})
    return stage(counted.drop("words"), "terms"), numbered


def idf_table(counted: DataFrame, numbered: DataFrame) -> DataFrame:
    """Smooth inverse document frequency, ln((1 + n) / (1 + df)) + 1, with a position per term."""
    held = counted.select(F.explode("positions").alias("position")).groupBy("position").agg(F.count("*").alias("df"))
    total = counted.agg(F.count("*")).scalar()
    weight = F.log((1 + total) / (1 + F.col("df"))) + 1
    return held.join(F.broadcast(numbered), "position").select("term", "df", weight.alias("idf"), "position")


def tfidf_l2(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """Documents with one weight per position, of length 1 per document; at most one entry per vocabulary term."""
    # No more values than the vocabulary has terms.
    values = [row["idf"] for row in idf.orderBy("position").collect()]
    known = F.expr(f"cast(array({', '.join(f'{value!r}D' for value in values)}) as array<double>)")
    raw = F.zip_with("positions", "counts", lambda position, count: count * known[position])
    weighted = counted.withColumn("raw", raw)
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda total, value: total + value * value))
    # An array of the one norm binds it, or it would be summed again for every value.
    weights = F.transform(F.array(norm), lambda length: F.transform("raw", lambda value: value / length))[0]
    return weighted.withColumn("weights", weights).drop("raw", "counts")


def fit_vectors(words: DataFrame, vocabulary_size: int = C.VOCABULARY) -> DataFrame:
    """Documents with their vectors; a document without vocabulary terms has an empty one."""
    counted, numbered = document_terms(words, limit_vocabulary(words, vocabulary_size))
    return tfidf_l2(counted, stage(idf_table(counted, numbered), "idf"))


def distinct_signatures(documents: DataFrame) -> DataFrame:
    """One row per signature with its vector, its fields and its best place in the tie order."""
    place = F.struct(
        (F.col("resolved_at").isNull()).alias("no_resolved"), "resolved_at",
        (F.col("updated_at").isNull()).alias("no_updated"), "updated_at", "id",
    )
    content = F.struct("positions", "weights", *MATCHED, "has_notes")
    grouped = documents.groupBy("signature").agg(F.any_value(content).alias("content"), F.max(place).alias("place"))
    return grouped.select("signature", "place", "content.*")


def structured_bonus(current: Column, candidate: Column) -> Column:
    """Sum of the weights of equal, non-empty fields and of a resolved candidate with notes."""
    total = F.lit(0.0)
    for name, weight in C.BONUS:
        mine = empty_to_null(current[name].cast("string"))
        equal = (mine == candidate[name].cast("string")) & (mine != "0" if name == "status_code" else F.lit(True))
        total = total + F.when(equal, weight).otherwise(0.0)
    noted = (F.upper(candidate["status"]) == "RESOLVED") & empty_to_null(candidate["notes"]).isNotNull()
    return total + F.when(noted, C.BONUS_NOTES).otherwise(0.0)


class _Vectors:
    """Sparse rows, the entries of all rows one after the other."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.width = width
        self.sizes = frame["positions"].str.len().to_numpy(int)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        filled = self.sizes.sum() > 0
        self.positions = np.concatenate(frame["positions"].to_list()).astype(np.int32) if filled else np.empty(0, np.int32)
        self.weights = np.concatenate(frame["weights"].to_list()).astype(float) if filled else np.empty(0)

    def entries(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (from 0), position and weight of every entry of some rows."""
        own = slice(self.starts[start], self.starts[end])
        return np.repeat(np.arange(end - start), self.sizes[start:end]), self.positions[own], self.weights[own]

    def dense(self, start: int, end: int) -> np.ndarray:
        matrix = np.zeros((end - start, self.width))
        rows, positions, weights = self.entries(start, end)
        matrix[rows, positions] = weights
        return matrix

    def group_norms(self, start: int, end: int, groups: np.ndarray, size: int) -> np.ndarray:
        """The length of every row within each group of terms; terms of group -1 are left out."""
        rows, positions, weights = self.entries(start, end)
        at = groups[positions]
        held = at >= 0
        squares = np.bincount(rows[held] * size + at[held], weights[held] ** 2, (end - start) * size)
        return np.sqrt(squares).astype(np.float32).reshape(end - start, size)

    def dots(self, rows: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Products of some of these rows with rows of a dense matrix, pair by pair."""
        found, flat = np.zeros(len(rows)), other.ravel()
        for first in range(0, len(rows), PICKED):
            own = slice(first, first + PICKED)
            sizes = self.sizes[rows[own]]
            ends = np.cumsum(sizes)
            entry = np.repeat(self.starts[rows[own]] - ends + sizes, sizes)
            entry += np.arange(len(entry))
            at = np.repeat(others[own] * self.width, sizes)
            at += self.positions.take(entry)
            products = flat.take(at) * self.weights.take(entry)
            filled = np.flatnonzero(sizes)
            if len(filled):
                found[first + filled] = np.add.reduceat(products, (ends - sizes)[filled])
        return found


def _pair_dots(left: np.ndarray, rows: np.ndarray, right: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Products of rows of two dense matrices, pair by pair."""
    found = np.empty(len(rows), left.dtype)
    for first in range(0, len(rows), PICKED):
        own = slice(first, first + PICKED)
        found[own] = np.einsum("ij,ij->i", left[rows[own]], right[others[own]])
    return found


def _codes(queries: pd.DataFrame, candidates: pd.DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The weight of every field that some query and candidate share, with both sides' values as numbers (none: -1)."""
    found = []
    for name, weight in C.BONUS:
        values = {value: n for n, value in enumerate(queries[name].unique()) if value != ""}
        mine = queries[name].map(values).fillna(-1).to_numpy(np.int32)
        other = candidates[name].map(values).fillna(-2).to_numpy(np.int32)
        if len(values) and (other >= 0).any():
            found.append((weight, mine, other))
    return found


def _runs(change: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of rows, cut where `change` says so once they hold `least` rows."""
    found, start = [], 0
    for cut in [*(np.flatnonzero(change[1:]) + 1).tolist(), len(change)]:
        if cut - start >= least or cut == len(change):
            found.append((start, cut))
            start = cut
    return found


def _group_terms(energy: np.ndarray, size: int) -> np.ndarray:
    """Terms in at most `size` groups of about equal energy, heavy ones alone; -1 for terms that nobody has."""
    groups = np.full(len(energy), -1)
    order = np.argsort(-energy, kind="stable")[:np.count_nonzero(energy)]
    left, group, held = energy.sum(), 0, 0.0
    for term in order:
        if held and group < size - 1 and held + energy[term] > left / (size - group):
            left, group, held = left - held, group + 1, 0.0
        groups[term] = group
        held += energy[term]
    return groups


class _Segment:
    """Neighbouring candidates with one grouping of the terms for each level, made when first needed.

    `same` and `few` hold the fields with one value and those with few, by number; the latter's values get a column each beside the
    groups. What is left is compared pair by pair.
    """

    def __init__(self, vectors: _Vectors, start: int, end: int, codes: list[np.ndarray]):
        self.vectors, self.start, self.end = vectors, start, end
        _, positions, weights = vectors.entries(start, end)
        self.energy = np.bincount(positions, weights ** 2, vectors.width)
        terms = np.count_nonzero(self.energy)
        self.sizes = [size for size in LEVELS if size < terms] + [max(1, terms)]
        self.exact, self.fine = len(self.sizes) - 1, len(self.sizes) - 2
        values = [np.unique(theirs[start:end]) for theirs in codes]
        self.same = {n: held[0] for n, held in enumerate(values) if len(held) == 1}
        self.few = {n: held for n, held in enumerate(values) if 1 < len(held) <= COLUMNS}
        self.many = [n for n, held in enumerate(values) if len(held) > COLUMNS]
        self.columns = [codes[n][start:end, None] == held for n, held in self.few.items()]
        self.groups, self.norms, self.levels, self.latest = {}, {}, {}, min(FIRST_LEVEL, self.exact)

    def grouping(self, level: int) -> tuple[np.ndarray, int]:
        if level not in self.groups:
            self.groups[level] = _group_terms(self.energy, self.sizes[level])
        return self.groups[level], self.sizes[level]

    def _wide(self, level: int, start: int, end: int) -> np.ndarray:
        norms = self.vectors.group_norms(start, end, *self.grouping(level))
        return np.hstack([norms, *(c[start - self.start:end - self.start].astype(np.float32) for c in self.columns)])

    def candidates(self, level: int, start: int, end: int) -> np.ndarray:
        if level == self.exact:  # one group a term: too wide to be kept
            return self._wide(level, start, end)
        if level not in self.norms:
            self.norms[level] = self._wide(level, self.start, self.end)
        return self.norms[level][start - self.start:end - self.start]

    def adapt(self, kind: tuple, level: int, passed: float) -> None:
        """A finer level while scoring what passed costs more than the step, a coarser one where it costs next to nothing."""
        cost, size = PAIR_COST * passed, self.sizes[level]
        if level < self.exact and cost > self.sizes[level + 1] - size:
            level += 1
        elif level and COARSER * cost < size - self.sizes[level - 1]:
            level -= 1
        self.levels[kind] = self.latest = level


class _Best:
    """The best `keep` candidates of every query of a tile: rounded score, then place in the tie order (0: first)."""

    def __init__(self, queries: int, keep: int, floor: np.ndarray):
        self.keep, self.floor = keep, floor
        self.scores = np.full((queries, keep), -1.0)
        self.places = np.full((queries, keep), -1)

    def needed(self, first_place: int) -> np.ndarray:
        """The least exact score that matters among candidates from a place on; infinite where none can."""
        worst = self.scores[:, -1]
        # A tie goes to the earlier place; the floor comes from candidates that are all earlier. 1 is never exceeded.
        late = self.places[:, -1] < first_place
        least = np.maximum(worst + np.where(late, HALF, -HALF), self.floor + HALF) - MARGIN
        least[worst < 0] = self.floor[worst < 0] + HALF - MARGIN
        least[(late & (worst >= 1)) | (self.floor >= 1)] = np.inf
        return least

    def add(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        worst = self.scores[rows, -1]
        better = (scores > worst) | ((scores == worst) & (places < self.places[rows, -1]))
        better &= scores > self.floor[rows]
        if not better.any():
            return
        rows, scores, places = rows[better], scores[better], places[better]
        changed = np.unique(rows)
        every = np.concatenate([rows, np.repeat(changed, self.keep)])
        scores = np.concatenate([scores, self.scores[changed].ravel()])
        places = np.concatenate([places, self.places[changed].ravel()])
        order = np.lexsort((places, -scores, every))
        first = np.searchsorted(every[order], changed)
        chosen = order[first[:, None] + np.arange(self.keep)]
        self.scores[changed], self.places[changed] = scores[chosen], places[chosen]


def _compare(keep: int, width: int):
    """Best candidates of one shard for every query of one block.

    Terms are put in groups, and a pair's product is at most the sum over groups of both sides' lengths in the group (Cauchy and
    Schwarz). So a product of short rows in single precision bounds all scores of a tile; only pairs that could reach a
    query's worst kept score are scored, in double precision, so rounded scores and their ties are exact. While no
    scores are known both sides lie by matched fields, in tie order, so the best candidates come first and later ties are left
    out; then by the first field and their number of terms, since rows of few terms are ruled out by few groups.
    """

    def tile(asked: _Vectors, start: int, end: int, fields, floor, other: _Vectors, places, noted, chunks, cold) -> _Best:
        best = _Best(end - start, keep, floor)
        matrix = asked.dense(start, end)
        made = {}

        def rows_of(segment: _Segment, level: int) -> np.ndarray:
            if (segment, level) not in made:
                norms = asked.group_norms(start, end, *segment.grouping(level))
                columns = [weight * (mine[:, None] == held) for n, held in segment.few.items() for weight, mine, _ in [fields[n]]]
                made[segment, level] = np.hstack([norms, *(c.astype(np.float32) for c in columns)])
            return made[segment, level]

        def bonus_of(segment: _Segment) -> np.ndarray:
            if segment not in made:
                made[segment] = np.zeros(end - start)
                for n, value in segment.same.items():
                    made[segment] += fields[n][0] * (fields[n][1] == value)
            return made[segment]

        fresh = 0
        if not cold:
            promise = [bonus_of(segment).mean() for segment, _, _ in chunks]
            queue = [chunks[n] for n in np.argsort(promise, kind="stable")[::-1]]
        else:  # the first ones are short, so that few pairs pass before good scores are known
            promise = [sum(weight * np.mean(mine == theirs[first]) for weight, mine, theirs in fields) for _, first, _ in chunks]
            queue = [chunks[n] for n in np.lexsort(([places[first] for _, first, _ in chunks], -np.array(promise)))]
            segment, first, last = queue[0]
            cuts = [first]
            while cuts[-1] < last:
                cuts.append(min(last, first + max(FIRST_CHUNK, 4 * (cuts[-1] - first))))
            fresh = len(cuts) - 1
            queue[:1] = [(segment, *cut) for cut in zip(cuts, cuts[1:])]
        for step, (segment, first, last) in enumerate(queue):
            bonus = bonus_of(segment)
            need = best.needed(places[first:last].min()) - bonus
            alive = np.flatnonzero(need < np.inf)
            if not len(alive):
                continue
            # In the first ones a term is a group, so a bound is the score itself and ranks the pairs.
            kind = first, round(bonus.mean() / KIND)
            level = segment.levels.get(kind, segment.latest) if step >= fresh else segment.exact
            while True:
                rough = rows_of(segment, level)
                bounds = (rough if len(alive) == len(rough) else rough[alive]) @ segment.candidates(level, first, last).T
                for weight, mine, theirs in (fields[n] for n in segment.many):
                    bounds += np.float32(weight) * (mine[alive][:, None] == theirs[None, first:last])
                least = need[alive]
                if step < fresh and keep < last - first:
                    reached = np.partition(bounds, -keep, axis=1)[:, -keep]
                    least = np.maximum(least, np.minimum(1 - bonus[alive], reached) - 2 * HALF - MARGIN)
                hits = np.flatnonzero((bounds >= least.astype(np.float32)[:, None]).ravel())
                if level == segment.exact or len(hits) * RAISE_SHARE <= bounds.size:
                    break
                level = min(level + 2, segment.exact)
            reach = bounds.ravel()[hits]
            rows, hits = hits // (last - first), first + hits % (last - first)
            # A row's most promising ones come first: what they score rules out most others.
            turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
            if len(rows) and turn.max() >= 2 * keep:
                order = np.lexsort((-reach, rows))
                turns = [order[turn < 2 * keep], np.sort(order[turn >= 2 * keep])]
            else:
                turns = [np.arange(len(rows))]
            passed = 0
            for chosen in turns:
                own, mates = alive[rows[chosen]], hits[chosen]
                worst = best.scores[own, -1]
                least = np.maximum(worst - HALF, floor[own] + HALF) - MARGIN - bonus[own]
                # Where a query's best are all 1, only earlier places matter.
                left = (reach[chosen] >= least) & ((worst < 1) | (places[mates] < best.places[own, -1]))
                own, mates, least = own[left], mates[left], least[left]
                passed += len(own)
                whole = len(own) * DENSE_SHARE > bounds.size
                if level < segment.fine and not whole:  # a finer bound of a single pair is cheaper than a score
                    most = _pair_dots(rows_of(segment, segment.fine), own, segment.candidates(segment.fine, first, last), mates - first)
                    for weight, mine, theirs in (fields[n] for n in segment.many):
                        most = most + weight * (mine[own] == theirs[mates])
                    own, mates = own[most >= least], mates[most >= least]
                if not len(own):
                    continue
                total = noted[mates]
                for weight, mine, theirs in fields[:-1]:
                    total = total + weight * (mine[own] == theirs[mates])
                if whole:
                    dots = (matrix @ other.dense(first, last).T)[own, mates - first]
                else:
                    dots = other.dots(mates, matrix, own)
                best.add(own, np.round(np.minimum(1.0, dots + total), 4), places[mates])
            if step >= fresh:
                segment.adapt(kind, level, passed / bounds.size)
        return best

    def compare(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame([], columns=MATCHES)
        queries = queries.rename(columns=lambda name: name.removeprefix(ASKED))
        cold = "floor" not in queries or (queries["floor"] < 0).any()
        queries = queries.assign(terms=queries["positions"].str.len())
        queries = queries.sort_values(MATCHED if cold else [MATCHED[0], "terms"], ignore_index=True)
        candidates = candidates.sort_values(PLACE, ascending=False, na_position="last", ignore_index=True)
        names = candidates["signature"].to_numpy()
        candidates = candidates.rename_axis("rank").reset_index().assign(terms=candidates["positions"].str.len())
        candidates = candidates.sort_values([*MATCHED, "has_notes", "rank"] if cold else [MATCHED[0], "terms", "rank"], ignore_index=True)
        places = candidates["rank"].to_numpy()
        asked, other = _Vectors(queries, width), _Vectors(candidates, width)
        noted = C.BONUS_NOTES * candidates["has_notes"].to_numpy(bool)
        # Notes come last, as a field that every query shares with the candidates that have some.
        fields = [*_codes(queries, candidates), (C.BONUS_NOTES, np.ones(len(queries), np.int32), np.sign(noted).astype(np.int32))]
        floors = queries["floor"].to_numpy(float) if "floor" in queries else np.full(len(queries), -1.0)
        codes = [theirs for _, _, theirs in fields]
        change = (candidates[MATCHED[0]] != candidates[MATCHED[0]].shift()).to_numpy()
        chunks = []
        for start, end in _runs(change, SEGMENT):
            segment = _Segment(other, start, end, codes)
            chunks += [(segment, first, min(first + CHUNK, end)) for first in range(start, end, CHUNK)]
        found = []
        for start in range(0, len(queries), TILE):
            end = min(start + TILE, len(queries))
            own = [(weight, mine[start:end], theirs) for weight, mine, theirs in fields]
            best = tile(asked, start, end, own, floors[start:end], other, places, noted, chunks, cold)
            rows, columns = np.nonzero(best.places >= 0)
            signature = queries["signature"].to_numpy()[start:end][rows]
            found.append(pd.DataFrame(dict(zip(MATCHES, (signature, names[best.places[rows, columns]], best.scores[rows, columns])))))
        return pd.concat(found, ignore_index=True)

    return compare


def _cells(queries: DataFrame, candidates: DataFrame, keep: int, width: int, asked: int, known: int) -> DataFrame:
    """The best `keep` candidates per shard for each query, found in cells of one block of queries and one shard of candidates each."""
    blocks, shards = -(-asked // QUERY_BLOCK) or 1, -(-known // CANDIDATE_SHARD) or 1
    # At least two cells a core. A query's first comparisons in a shard cost more than what a block costs a candidate.
    cells = 2 * queries.sparkSession.sparkContext.defaultParallelism
    if blocks * shards < cells:
        shards = max(shards, min(cells, round((cells * known / max(1, asked)) ** 0.5 / 2)))
        blocks = max(blocks, -(-cells // shards))
    used = ["signature", "positions", "weights", *MATCHED, "has_notes"]
    # A cell is small but takes long: each gets a partition of its own, by a number whose hash is that partition's.
    count = blocks * shards
    numbers = queries.sparkSession.range(32 * count).select(F.col("id").cast("int").alias("number"))
    numbers = numbers.groupBy(F.pmod(F.hash("number"), F.lit(count)).alias("partition")).agg(F.min("number").alias("number"))
    labels = [row["number"] for row in numbers.orderBy("partition").collect()]
    labels += range(32 * count, 33 * count - len(labels))  # hardly ever
    label = F.array(*map(F.lit, labels))

    def cell(block: Column, shard: Column) -> Column:
        return F.get(label, (block * shards + shard).cast("int")).alias("cell")

    block, shard = F.pmod(F.xxhash64("signature"), F.lit(blocks)), F.pmod(F.hash("signature"), F.lit(shards))
    each = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n") for n in (shards, blocks)]
    own = queries.select(block.alias("own"), each[0], *used, "floor")
    own = own.select(cell(F.col("own"), F.col("n")), *used, "floor")
    other = candidates.select(shard.alias("own"), each[1], *used, "place.*")
    other = other.select(cell(F.col("n"), F.col("own")), *used, *PLACE)
    own = own.toDF(*[ASKED + name for name in own.columns])
    return (
        own.repartition(count, f"{ASKED}cell").groupBy(f"{ASKED}cell")
        .cogroup(other.repartition(count, "cell").groupBy("cell"))
        .applyInPandas(_compare(keep, width), "query_signature binary, signature binary, score double")
    )


def _place_from(place: Row, fields: StructType) -> Column:
    """Whether a candidate lies at or before a place; any place divides the candidates in two."""
    bound = F.struct(*[F.lit(place[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    return F.col("place") >= bound


def cosine_matches(queries: DataFrame, candidates: DataFrame, keep: int, width: int) -> DataFrame:
    """The best candidates for each query signature with rounded scores, at least `keep` where there are as many, ties in place order.

    A query travels once per shard and a candidate once per block of queries; a task holds one of each as sparse vectors. Many pairs
    are compared in rounds, candidates of the earliest places first: what a round finds bounds the next ones, and a query
    whose best all score 1 is answered, since later places lose every tie.
    """
    asked, known = queries.count(), candidates.count()
    queries = queries.withColumn("floor", F.lit(-1.0))
    first = -(-ROUND_PAIRS // max(1, asked))
    ends = []
    while known > 2 * (end := first * ROUND_GROWTH ** len(ends)):
        ends.append(end)
    if not ends:
        return stage(_cells(queries, candidates, keep, width, asked, known), "matches")
    # Places at about these ranks, from a sample; where exactly a round ends does not matter.
    few = F.pmod(F.xxhash64("signature"), F.lit(max(1, known // SAMPLED))) == 0
    sample = candidates.filter(few).select("place").orderBy(F.col("place").desc()).collect()
    fields = candidates.schema["place"].dataType
    places = [sample[len(sample) * end // known]["place"] for end in ends if sample]
    cuts = [F.lit(False), *[_place_from(place, fields) for place in places], F.lit(True)]
    found = None
    for before, until in zip(cuts, cuts[1:]):
        part = candidates.filter(until & ~before)
        if found is not None:
            best = F.sort_array(F.collect_list("score"), asc=False)
            floors = found.groupBy(F.col("query_signature").alias("signature")).agg(F.get(best, F.lit(keep - 1)).alias("floor"))
            queries = queries.drop("floor").join(floors, "signature", "left").fillna(-1.0, "floor").filter(F.col("floor") < 1)
            asked = queries.count()
        matches = stage(_cells(queries, part, keep, width, asked, part.count()), "matches")
        found = matches if found is None else found.unionByName(matches)
    return found


def find_similar_incidents(
    incidents: DataFrame,
    ids: DataFrame,
    k: int = 5,
    vocabulary_size: int = C.VOCABULARY,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """Ranked similar incidents (query_id, rank, similarity_score, candidate columns) per requested id."""
    stop_words = default_stop_words() if stop_words is None else stop_words
    keyed = signatures(incidents)
    wanted_ids = ids.select(F.col("incident_id").alias("id")).distinct()
    # Requested incidents are compared whatever fields they have; candidates need a signal.
    unknown = keyed.filter(~signal_of(keyed)).join(wanted_ids, "id", "left_semi")
    known = has_signal(keyed).withColumn("known", F.lit(True))
    fitted = known.unionByName(unknown.withColumn("known", F.lit(False)))
    words = document_words(fitted, stop_words, *map(F.col, ("resolved_at", "updated_at", "known")))
    vectors = fit_vectors(words, vocabulary_size)
    # What decides candidates and order, without texts; the texts of the best are fetched at the end.
    narrow = words.select("id", "signature", "resolved_at", "updated_at", "known")
    pool = narrow.filter("known").drop("known")
    asked = narrow.join(wanted_ids, "id", "left_semi")
    wanted = stage(distinct_signatures(vectors.join(wanted_ids, "id", "left_semi")), "wanted")
    documents = stage(distinct_signatures(vectors.filter("known")), "vectors")
    matches = cosine_matches(wanted, documents, k + 1, vocabulary_size)
    best = Window.partitionBy("query_signature").orderBy(F.col("score").desc(), F.col("place").desc())
    matches = matches.join(documents.select("signature", "place"), "signature")
    matches = matches.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)

    first = Window.partitionBy("signature").orderBy(*candidate_order())
    front = pool.join(matches.select("signature").distinct(), "signature", "left_semi")
    front = front.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).drop("copy")
    queries = asked.select(F.col("id").alias("query_id"), F.col("signature").alias("query_signature"))
    pairs = (
        queries.join(matches.select("query_signature", "signature", "score"), "query_signature")
        .join(front, "signature")
        .filter(F.col("id") != F.col("query_id"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *candidate_order())
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    shown = ["incident_number", "alert_name", "service_name", "status", "severity"]
    nested = ["parsed_log"] if "parsed_log" in incidents.columns else []
    return ranked.select("query_id", "rank", "id", "score").join(incidents, "id").select(
        "query_id", "rank", F.col("id").alias("incident_id"), *[c for c in shown if c in incidents.columns],
        F.col("score").alias("similarity_score"), "notes", "raw_log", *nested,
    )


def similarity_pairs(incidents: DataFrame, ids: DataFrame, **options) -> DataFrame:
    """The best pair scores as (query_id, incident_id, similarity_score)."""
    return find_similar_incidents(incidents, ids, **options).select("query_id", "incident_id", "similarity_score")


