"""Periodic runs of words: stretches that repeat with a period, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least max(``LEAST``, 2 q) words that cannot be made longer.
Every word of a run occurs at least twice in it, so a word that occurs once in a segment belongs to no run there: it
splits the segment, words of the parts are counted anew, and so on until nothing splits any more; parts of less than
``LEAST`` words are left out. Ordinary text falls apart in a few rounds. Rounds are done for all texts of a slice at
once; segments that only lose words at their edges, round after round, are finished by a scan from both ends (its cost
is the shorter part of each split, so n log n at most).

The lag scan looks at lag q only at every q-th word of the segments with at least 2 q words (a run of period q holds q
equal pairs in a row, so one of these is among them): n log n pairs for a segment of n words. Equal pairs are extended
to both sides by ranks of blocks of 1, 2, 4, ... words, which are exact (no hashing). Memory is some 4 log2(n) bytes a
word of the segments that survive.

Words are the parts between blanks, tabs and line ends. Null and empty texts have no words and no runs; the collapsed
text of null is the empty text. Repeated rows get equal results, an empty table an empty one; other columns are kept,
columns named like the two results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import CRC32_SQL, prepare, query, slices, table, utf8

#: Words of the shortest run.
LEAST = 12
#: Rounds of splitting for all texts of a slice at once, before the scan from both ends takes over.
ROUNDS = 8
#: Pairs looked at together in the lag scan.
PAIRS = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges in a row."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def split_rest(ids: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of one segment in which every word occurs twice, splitting at words found from both ends."""
    part = ids[start:end]
    order = np.argsort(part, kind="stable")
    same = part[order[1:]] == part[order[:-1]]
    before, after = np.full(len(part), -1), np.full(len(part), len(part))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    before, after = before.tolist(), after.tolist()
    work, out = [(0, len(part))], []
    while work:
        low, high = work.pop()
        if high - low < LEAST:
            continue
        a, b = low, high - 1
        while a <= b:
            if before[a] < low and after[a] >= high:
                work += [(low, a), (a + 1, high)]
                break
            if before[b] < low and after[b] >= high:
                work += [(low, b), (b + 1, high)]
                break
            a, b = a + 1, b - 1
        else:
            out.append((start + low, start + high))
    return out


def segments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts in which every word occurs at least twice, of ``LEAST`` words or more."""
    starts, ends = np.array([0]), np.array([len(ids)])
    done: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        lengths = ends - starts
        at = spread(starts, lengths)
        segment = np.repeat(np.arange(len(starts)), lengths)
        _, which, many = np.unique(segment * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = many[which] >= 2
        lost = np.bincount(segment[~keep], minlength=len(starts)) > 0
        done += zip(starts[~lost].tolist(), ends[~lost].tolist(), strict=True)
        at, segment = at[keep & lost[segment]], segment[keep & lost[segment]]
        if not len(at):
            starts = ends = at
            break
        edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(segment) != 0)) + 1
        starts, ends = at[np.concatenate([[0], edge])], at[np.concatenate([edge - 1, [len(at) - 1]])] + 1
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
    for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
        done += split_rest(ids, low, high)
    done = [(a, b) for a, b in done if b - a >= LEAST]
    return np.array([a for a, _ in done], np.int64), np.array([b for _, b in done], np.int64)


def block_ranks(line: np.ndarray, longest: int) -> np.ndarray:
    """Row k numbers the blocks of 2**k items that begin at each place: equal numbers, equal blocks. -1 beyond the end."""
    rows = [np.unique(line, return_inverse=True)[1].astype(np.int32)]
    half = 1
    while 2 * half <= longest:
        last = rows[-1].astype(np.int64)
        pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
        pairs = pairs[: len(line) - 2 * half + 1]
        row = np.full(len(line), -1, np.int32)
        row[: len(pairs)] = np.unique(pairs, return_inverse=True)[1]
        rows.append(row)
        half *= 2
    return np.stack(rows)


def lag_scan(line: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs of ``line``; lag q is looked for in the first ``reach[q]`` items."""
    most, n = len(reach) - 1, len(line)
    ranks = block_ranks(line, 2 * most)
    found = []
    anchors = np.zeros(most + 1, np.int64)
    anchors[1:] = np.maximum(reach[1:] - 1, 0) // np.arange(1, most + 1)
    total = np.cumsum(anchors)
    low = 1
    while low <= most:
        high = max(low + 1, int(np.searchsorted(total, total[low - 1] + PAIRS, "right")))
        lags = np.arange(low, min(high, most + 1))
        low = high
        lag = np.repeat(lags, anchors[lags])
        at = spread(np.zeros(len(lags), np.int64), anchors[lags]) * lag
        hit = ranks[0][at] == ranks[0][at + lag]
        at, lag = at[hit], lag[hit]
        # Only the first place of a stretch: not if the lag's words before this one equal those from here on.
        size = np.floor(np.log2(lag)).astype(np.int64)
        back = np.maximum(at - lag, 0)
        again = (at >= lag) & (ranks[size, back] == ranks[size, at])
        again &= ranks[size, np.maximum(at - (1 << size), 0)] == ranks[size, at + lag - (1 << size)]
        at, lag = at[~again], lag[~again]
        left, right = at.copy(), at.copy()
        # Longest first, each size as often as it fits: equal stretches can be longer than twice the largest block.
        for k in reversed(range(len(ranks))):
            step, row = 1 << k, ranks[k]
            go = np.arange(len(at))
            while len(go):
                i, j = right[go], right[go] + lag[go]
                go = go[(j + step <= n) & (row[np.minimum(i, n - 1)] == row[np.minimum(j, n - 1)])]
                right[go] += step
            go = np.arange(len(at))
            while len(go):
                i = left[go] - step
                go = go[(i >= 0) & (row[np.maximum(i, 0)] == row[np.maximum(i, 0) + lag[go]])]
                left[go] -= step
        end = right + lag
        long = end - left >= np.maximum(LEAST, 2 * lag)
        found.append((left[long], end[long], lag[long]))
    start, end, lag = (np.concatenate(x) for x in zip(*found, strict=True))
    # A stretch found with several lags has the smallest one as its period, the others are multiples of it.
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], lag[new]


def find_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs in a sequence of word numbers, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(ids) < LEAST:
        return none, none, none
    starts, ends = segments(ids)
    if not len(starts):
        return none, none, none
    # Longest first: what lag q can be found in is a prefix. A number of its own stands behind each segment.
    order = np.argsort(starts - ends, kind="stable")
    starts, lengths = starts[order], (ends - starts)[order]
    begin = np.cumsum(lengths + 1) - lengths - 1
    line = np.empty(int((lengths + 1).sum()), np.int64)
    line[begin + lengths] = int(ids.max()) + 1 + np.arange(len(begin))
    line[spread(begin, lengths)] = ids[spread(starts, lengths)]
    most = int(lengths[0]) // 2
    fits = np.searchsorted(-lengths, -2 * np.arange(most + 1), "right")
    reach = np.concatenate([[0], begin + lengths])[fits]
    left, right, lag = lag_scan(line, reach)
    shift = (starts - begin)[np.searchsorted(begin, left, "right") - 1]
    left, right = left + shift, right + shift
    order = np.lexsort((lag, left))
    return left[order], right[order], lag[order]


def runs_of(column: pa.Array) -> pa.Array:
    """Runs and collapsed text of each text of an Arrow column."""
    column = column if column.type == pa.string() else column.cast(pa.string())
    column = column.fill_null("")
    data, offsets = utf8(column)
    counts, parts, texts = [np.zeros(1, np.int64)], [], []
    for i, j in slices(offsets):
        split = [data[offsets[r] : offsets[r + 1]].tobytes().split() for r in range(i, j)]
        numbers, base = [], 0
        for got in split:  # numbers of one text differ from those of all others
            known: dict[bytes, int] = {}
            numbers.append(np.fromiter((known.setdefault(w, base + len(known)) for w in got), np.int64, len(got)))
            base += len(known)
        at = np.cumsum([0, *map(len, split)])
        start, end, lag = find_runs(np.concatenate(numbers))
        row = np.searchsorted(at, start, "right") - 1
        first = np.searchsorted(row, np.arange(len(split) + 1))
        counts.append(np.diff(first))
        parts.append((start - at[row], end - start, lag))
        edge = np.zeros(at[-1] + 1, np.int64)
        np.add.at(edge, start + lag, 1)
        np.add.at(edge, end, -1)
        keep = np.cumsum(edge) == 0
        for r, got in enumerate(split):
            if first[r] < first[r + 1]:
                got = [w for w, k in zip(got, keep[at[r] : at[r + 1]].tolist(), strict=True) if k]
            texts.append(b" ".join(got).decode())
    start, length, lag = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(3))
    items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, lag)], fields=list(RUNS.value_type))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), items)
    return pa.StructArray.from_arrays([lists, pa.array(texts, pa.string())], ["runs", "collapsed"])


def collapse_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each whole text (start, length, period in words, by start) and the text without repeats.

    The collapsed text keeps the first period of each run; its words are joined by one blank.
    """
    prepare(docs.sparkSession)
    kind = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
    found = docs.withColumn("__found", F.arrow_udf(runs_of, kind)(F.col(text)))
    return found.withColumns({runs: F.col("__found.runs"), collapsed: F.col("__found.collapsed")}).drop("__found")


def plant_periods(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The texts of the query: for each tenth id, words from a place on are a repetition of the first of them.

    A null id counts as none of these.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("__words", F.when(h % 10 == 0, split))
    n = F.greatest(F.size("__words"), F.lit(1))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("__words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    told = F.array_join(F.concat(F.slice("__words", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return rows.withColumn(text, F.when(F.size("__words") > 0, told).otherwise(F.col(text))).drop("__words")


#: Every pair of equal words of a text, then stretches of neighbouring pairs of one lag.
SQL = f"""WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    CASE WHEN doc_id IS NULL THEN 1 ELSE {CRC32_SQL} END::BIGINT AS h FROM documents),
sized AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM docs),
planned AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
words AS (SELECT id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM planned, unnest(range(n)) t(i)),
pairs AS (SELECT x.id, x.i, y.i - x.i AS q FROM words x JOIN words y ON y.id = x.id AND y.word = x.word AND y.i > x.i AND y.i - x.i <= x.n // 2),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT id, q, min(i) AS s, max(i) + q + 1 AS e FROM islands GROUP BY id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT id, s, e, min(q) AS q FROM stretches GROUP BY id, s, e),
told AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY id),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY e - s DESC, s, q) = 1),
dropped AS (SELECT DISTINCT id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (id, i) GROUP BY id)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, l.s AS start, l.e - l.s AS length, l.q AS period, 1000 * (l.e - l.s) // l.q AS exponent_milli,
  sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told t USING (id) LEFT JOIN longest l USING (id) LEFT JOIN kept k USING (id)"""


@query("op12_periodic_runs", SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = collapse_runs(plant_periods(table(spark, sf, "documents").select("doc_id", "text")))
    longest = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), 1)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    best = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
