"""A hidden Markov language model: latent states trained by Baum-Welch over all learned texts, and exact likelihoods by the scaled forward recursion.

Texts become pieces: rows of many texts with their tokens as numbers of the piece's own different words, written once. Every round of
Baum-Welch runs forward and backward over all pieces; each task adds up its expected counts and one row per class of words and state goes to
the sum. During these rounds words share emissions by class (a short word's hash, a longer one's first and last bytes), so a round's model has a fixed size.
A last round counts for every word: each piece tells its words' occurrences and states, the rows meet by word, and each piece gets back its words' counts and shares of states
for the whole corpus. Emissions of all words so grow with the corpus and are never in one place.

Expected counts travel as whole numbers, so sums don't depend on their order. Scoring multiplies and adds in a fixed order:
equal texts get equal scores in whatever piece they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut
from strandloom.llm.words import hashes, joined, mix64, numbered, pieces, spans

STATES = 8  # at most eight: shares travel as one byte each
ROUNDS = 8  # of Baum-Welch over classes of words
CLASSES = 4096  # the first of them is the end alone
PIECE = 16 << 20  # bytes of text in a piece
BLOCK = 1 << 19  # tokens looked at together
SCALE = 4  # steps between scalings, by which no value leaves the range of single precision
RAREST = 1e-9  # chance of a class in any state at least; SCALE steps of it stay above zero
WIDE = 256  # texts from which on a step's sums are made state by state
ROWS = 1 << 19  # of words and pieces matched at a time
UNIT = 1 << 16  # expected counts travel as multiples of 1 / UNIT
SEED = 7
STAY = 0.8  # chance of staying in a state before the first round
END = ""  # the token behind a text's last word; no word is empty


@dataclass(frozen=True)
class Chain:
    start: np.ndarray  # (state)
    move: np.ndarray  # (from, to)
    emit: np.ndarray  # (state, class)


@dataclass(frozen=True)
class Totals:
    tokens: int  # N: learned tokens
    words: int  # V: different ones
    mass: np.ndarray  # expected tokens of each state
    kinds: np.ndarray  # expected different words of each state


def _classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    short = ends - starts <= 5
    first = hashes(data, starts, np.where(short, ends, np.minimum(starts + 3, ends)))
    last = hashes(data, np.where(short, starts, ends - 3), ends)
    return (mix64(first * np.uint64(31) + last) % np.uint64(CLASSES - 1)).astype(np.uint16) + np.uint16(1)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for batch, texts in pieces(batches, "body", PIECE):
        data, at = joined(texts)
        starts, ends = spans(data)
        ids, first, _ = numbered(data, starts, ends)
        cuts = np.searchsorted(starts, at)
        n = np.diff(cuts) + 1  # with the end
        tokens = np.full(int(n.sum()), len(first), np.int32)
        own = np.ones(len(tokens), bool)
        own[np.cumsum(n) - 1] = False
        tokens[own] = ids
        words = [data[a:b].tobytes().decode() for a, b in zip(starts[first], ends[first])] + [END]
        classes = np.append(_classes(data, starts[first], ends[first]), np.uint16(0))
        learn = np.array(batch.column(batch.schema.get_field_index("learn")).to_pylist(), bool)
        counts = np.bincount(tokens[np.repeat(learn, n)], minlength=len(words)).astype(np.int32)
        row = {
            "piece": pa.array([part << 32 | k], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(batch.schema.get_field_index("doc_id"))),
            "learn": pa.array([learn.tolist()], pa.list_(pa.bool_())),
            "lengths": pa.array([n.astype(np.int32).tobytes()], pa.binary()),
            "tokens": pa.array([tokens.tobytes()], pa.binary()),
            "classes": pa.array([classes.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "words": pa.array([words], pa.list_(pa.string())),
        }
        k += 1
        yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def tokenised(docs: DataFrame, learn: Column) -> DataFrame:
    """The texts as pieces, written. learn: whether a text is learned from; null doesn't count as such."""
    given = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("binary").alias("body"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"piece long, ids array<{kind}>, learn array<boolean>, lengths binary, tokens binary, classes binary, counts binary, words array<string>"
    return cut(given.mapInArrow(_tokenise, schema), "tokens", large_rows=True)


@dataclass(frozen=True)
class Block:
    """Tokens of some texts, step by step: first those of all texts, longest first, then those of all that have a second, and so on."""

    texts: np.ndarray
    tokens: np.ndarray
    of: np.ndarray  # each token's place among texts
    at: np.ndarray  # where each step starts


def blocks(lengths: np.ndarray, tokens: np.ndarray, use: np.ndarray) -> Iterator[Block]:
    ahead = np.cumsum(lengths) - lengths
    order = use[np.argsort(-lengths[use], kind="stable")]
    filled = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + BLOCK, "right")))
        own = order[at:end]
        size = lengths[own]
        steps = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts that have each step
        first = np.concatenate(([0], np.cumsum(steps)))
        of = np.repeat(np.arange(len(own)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        place = first[step] + of
        seen, text = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        seen[place] = tokens[np.repeat(ahead[own], size) + step]
        text[place] = of
        yield Block(own, seen, text, first)
        at = end


def last_tokens(at: np.ndarray) -> np.ndarray:
    """Where the texts of a block end: at each step those that have no other, its last ones."""
    texts = np.diff(at)
    over = texts - np.append(texts[1:], 0)
    first = at[1:] - over
    return np.arange(over.sum()) + np.repeat(first - (np.cumsum(over) - over), over)


def expected(chain: Chain, seen: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of each state at each token, expected moves, log likelihood) for emissions seen (token, state), which are used up.

    Forward values are scaled to 1 at every SCALE-th step, and at the end by what the backward values start with.
    """
    n, k = seen.shape
    fore, back, scale = np.empty_like(seen), np.ones_like(seen), np.ones((n, 1), seen.dtype)
    move = np.ascontiguousarray(chain.move.astype(seen.dtype))
    turned, moves = np.ascontiguousarray(move.T), np.zeros((k, k))
    edges = at.tolist()
    np.multiply(seen[: edges[1]], chain.start.astype(seen.dtype), out=fore[: edges[1]])
    for t in range(1, len(edges) - 1):
        a, b = edges[t], edges[t + 1]
        now = fore[a:b]
        np.matmul(fore[edges[t - 1] : edges[t - 1] + b - a], move, out=now)
        now *= seen[a:b]
        if t % SCALE == 0:
            scale[a:b] = now.sum(1, keepdims=True)
            now /= scale[a:b]
    last = last_tokens(at)
    ends = fore[last].sum(1, keepdims=True)  # of each text's last token
    back[last] = 1 / ends
    for t in range(len(edges) - 2, 0, -1):
        a, b, p = edges[t], edges[t + 1], edges[t - 1]
        later = seen[a:b]
        later *= back[a:b]
        if t % SCALE == 0:
            later /= scale[a:b]
        moves += fore[p : p + b - a].T @ later
        np.matmul(later, turned, out=back[p : p + b - a])
    fore *= back
    return fore, chain.move * moves, float(np.log(scale.astype(np.float64)).sum() + np.log(ends.astype(np.float64)).sum())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: its row, and its lengths, tokens and which texts are learned from."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
            arrays = [np.frombuffer(row[name].as_buffer(), np.int32) for name in ("lengths", "tokens")]
            yield row, arrays[0].astype(np.int64), arrays[1], np.flatnonzero(row["learn"].values.to_numpy(zero_copy_only=False))


def _round(chain: Chain, states: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per task and class (start: -1 and moves: from -2 down) with the expected counts of each state, in multiples of 1 / UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moved, started, likely = np.zeros((states, CLASSES)), np.zeros((states, states)), np.zeros(states), 0.0
        emit = np.ascontiguousarray(chain.emit.T, np.float32)
        for row, lengths, tokens, learned in _rows(batches):
            classes = np.frombuffer(row["classes"].as_buffer(), np.uint16).astype(np.int64)
            for b in blocks(lengths, tokens, learned):
                own = classes[b.tokens]
                share, moves, ll = expected(chain, emit[own], b.at)
                moved += moves
                likely += ll
                started += share[: b.at[1]].sum(0, dtype=np.float64)
                for s in range(states):
                    emitted[s] += np.bincount(own, weights=share[:, s], minlength=CLASSES)
        table = np.concatenate((emitted.T, started[None], moved, np.full((1, states), likely)))
        keys = np.concatenate((np.arange(CLASSES), -1 - np.arange(states + 2)))
        some = np.flatnonzero(table.any(1))
        whole = np.rint(table[some] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), *(pa.array(whole[:, s]) for s in range(states))], names=["class", *(f"s{s}" for s in range(states))])

    return run


def first_chain(states: int = STATES, seed: int = SEED) -> Chain:
    """Before the first round: sticky states whose emissions differ by chance."""
    rnd = np.random.default_rng(seed)
    emit = rnd.gamma(1.0, size=(states, CLASSES)) + 0.05
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def fit(table: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[Chain, list[float]]:
    """The chain after Baum-Welch, and the log likelihood that each round found. CLASSES + states + 2 rows reach the driver a round."""
    chain, likely = first_chain(states), []
    names = [f"s{s}" for s in range(states)]
    schema = "class long, " + ", ".join(f"{n} long" for n in names)
    for _ in range(rounds):
        told = table.select("learn", "lengths", "tokens", "classes").mapInArrow(_round(chain, states), schema)
        counts = np.zeros((CLASSES + states + 2, states))
        for r in told.groupBy("class").agg(*(F.sum(n).alias(n) for n in names)).collect():
            counts[r["class"] if r["class"] >= 0 else CLASSES - 1 - r["class"]] = [r[n] / UNIT for n in names]
        emitted, started, moved = counts[:CLASSES].T, counts[CLASSES], counts[CLASSES + 1 : -1]
        likely.append(float(counts[-1, 0]))
        share = emitted.sum(0) / max(emitted.sum(), 1)  # a little of the whole to each state, so that none is without a class
        emit = emitted + 10 * share + 1e-3
        emit = np.maximum(emit / emit.sum(1, keepdims=True), RAREST)
        chain = Chain((started + 1) / (started + 1).sum(), (moved + 1) / (moved + 1).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return chain, likely


def _told(chain: Chain, states: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, piece, pos, n, share) of every word of every piece: its learned occurrences, and the states' shares of them, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = np.ascontiguousarray(chain.emit.T, np.float32)
        for row, lengths, tokens, learned in _rows(batches):
            classes = np.frombuffer(row["classes"].as_buffer(), np.uint16).astype(np.int64)
            n = np.frombuffer(row["counts"].as_buffer(), np.int32)
            found = np.zeros((states, len(n)))
            for b in blocks(lengths, tokens, learned):
                share, _, _ = expected(chain, emit[classes[b.tokens]], b.at)
                for s in range(states):
                    found[s] += np.bincount(b.tokens, weights=share[:, s], minlength=len(n))
            bytes8 = np.zeros((len(n), 8), np.uint8)
            bytes8[:, :states] = np.rint(255 * found / np.maximum(n, 1)).clip(0, 255).T
            columns = [row["words"].values, pa.array(np.full(len(n), row["piece"].as_py())), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(bytes8.reshape(-1).view(np.int64))]
            whole = pa.RecordBatch.from_arrays(columns, names=["word", "piece", "pos", "n", "share"])
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    return run


TOLD = "word string, piece long, pos int, n int, share long"
ANSWER = "piece long, part int, pos binary, n binary, share binary, totals array<double>"


def _answers(states: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows by word: per piece, the corpus's counts and shares of its words; and one row of totals per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        totals = np.zeros(2 + 2 * states)

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            words = rows["word"].combine_chunks()
            new = np.concatenate(([True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)))
            heads, group = np.flatnonzero(new), np.cumsum(new) - 1
            n = rows["n"].to_numpy().astype(np.int64)
            share = np.ascontiguousarray(rows["share"].to_numpy()).view(np.uint8).reshape(-1, 8).astype(np.int64) * n[:, None]
            n, share = np.add.reduceat(n, heads), np.add.reduceat(share, heads)
            known = n > 0
            share = np.rint(255 * share / np.maximum(share.sum(1), 1)[:, None]).astype(np.uint8)
            part_of = share[:, :states] / np.maximum(share[:, :states].sum(1), 1)[:, None]
            totals[:2] += n.sum(), known.sum()
            totals[2 : 2 + states] += (part_of * n[:, None]).sum(0)
            totals[2 + states :] += part_of.sum(0)
            piece, pos = rows["piece"].to_numpy(), rows["pos"].to_numpy()
            order = np.lexsort((pos, piece))
            order = order[known[group[order]]]
            starts = np.flatnonzero(np.diff(piece[order], prepend=-1))
            packed = []
            for a, b in zip(starts, np.append(starts[1:], len(order))):
                of = order[a:b]
                packed.append((int(piece[of[0]]), part, np.diff(pos[of], prepend=0).astype("<i4").tobytes(), n[group[of]].tobytes(), share[group[of]].tobytes(), None))
            for at in range(0, len(packed), 32):
                yield _batch(packed[at : at + 32])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                rows = pa.Table.from_batches(held)
                words = rows["word"]
                last = words[len(words) - 1]
                whole = pc.index(pc.equal(words, last), True).as_py()  # the last word may go on
                if whole:
                    yield from out(rows.slice(0, whole))
                    rows = rows.slice(whole)
                held, size = rows.combine_chunks().to_batches(), rows.num_rows
        if size:
            yield from out(pa.Table.from_batches(held))
        yield _batch([(-1, part, None, None, None, totals.tolist())])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in ANSWER.split(", ")])


def word_counts(table: DataFrame, chain: Chain, states: int = STATES) -> tuple[DataFrame, Totals]:
    """(piece, pos, n, share): for each piece its known words' counts and states in the whole corpus, packed; and the corpus's totals.

    The rows of a word, one for each piece that holds it, are held together by one task.
    """
    told = table.select("piece", "learn", "lengths", "tokens", "classes", "counts", "words").mapInArrow(_told(chain, states), TOLD)
    answers = cut(told.repartition("word").sortWithinPartitions("word").mapInArrow(_answers(states), ANSWER), "word-counts")
    sums = np.zeros(2 + 2 * states)
    for r in sorted(answers.where("piece = -1").select("part", "totals").collect()):
        sums += np.array(r["totals"])
    return answers.where("piece >= 0").select("piece", "pos", "n", "share"), Totals(int(sums[0]), int(sums[1]), sums[2 : 2 + states], sums[2 + states :])


def emissions(n: np.ndarray, share: np.ndarray, totals: Totals) -> np.ndarray:
    """(state, word): a word's share of a state's tokens, with one more token for each of the state's different words, spread over all V known words and one for unknown ones.

    Over those V + 1 words every state's emissions add up to 1. A state without tokens emits all alike.
    """
    states = len(totals.mass)
    part = share[:, :states] / np.maximum(share[:, :states].sum(1), 1)[:, None]
    spread = np.maximum(totals.kinds, 1e-6)
    return np.stack([(part[:, s] * n + spread[s] / (totals.words + 1)) / (totals.mass[s] + spread[s]) for s in range(states)])


def log10_likelihood(start: np.ndarray, move: np.ndarray, emit: np.ndarray, block: Block) -> np.ndarray:
    """Each text's log10 probability, summed over all paths of states, for emissions by (state, token); sums run over states and steps in one order."""
    told, edges, seen = np.zeros(len(block.texts)), block.at.tolist(), emit[:, block.tokens]
    fore = np.empty((len(start), 0))
    for t in range(len(edges) - 1):
        a, b = edges[t], edges[t + 1]
        before = fore[:, : b - a]
        if t == 0:
            now = start[:, None] * seen[:, :b]
        elif b - a < WIDE:
            now = (before[:, None] * move[:, :, None]).sum(0)
            now *= seen[:, a:b]
        else:  # the same sums in the same order, without the products of all pairs of states at once
            now = before[0] * move[0][:, None]
            for k in range(1, len(start)):
                now += before[k] * move[k][:, None]
            now *= seen[:, a:b]
        if t % SCALE == 0:
            scale = now.sum(0)
            now /= scale
            told[: b - a] += np.log10(scale)
        stay = edges[t + 2] - b if t + 2 < len(edges) else 0
        if stay < b - a:  # these texts end here
            told[stay : b - a] += np.log10(now[:, stay:].sum(0))
        fore = now
    return told


def _scored(chain: Chain, totals: Totals) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lengths, tokens, _ in _rows(batches):
            size = row["size"].as_py()
            n, share = np.zeros(size, np.int64), np.zeros((size, 8), np.uint8)
            for a in row["answers"].as_py() or []:
                pos = np.cumsum(np.frombuffer(a["pos"], "<i4"))
                n[pos], share[pos] = np.frombuffer(a["n"], np.int64), np.frombuffer(a["share"], np.uint8).reshape(-1, 8)
            emit = emissions(n, share, totals)
            score = np.empty(len(lengths))
            for b in blocks(lengths, tokens, np.arange(len(lengths))):
                score[b.texts] = log10_likelihood(chain.start, chain.move, emit, b)
            of = np.repeat(np.arange(len(lengths)), lengths)
            alone = np.log10((n + 1) / (totals.tokens + totals.words + 1))
            base = np.bincount(of, weights=alone[tokens], minlength=len(lengths))
            known = np.bincount(of, weights=n[tokens] > 0, minlength=len(lengths)).astype(np.int64)
            columns = [row["ids"].values, row["learn"].values, pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), totals.tokens)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def likelihoods(docs: DataFrame, learn: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every text.

    A-Z are lower-cased; tokens are the words between ASCII space, and an end behind the last. n_known counts tokens that occur in learned texts, train_tokens
    all tokens of those. base_score is the log10 probability under single tokens with one more of each; score that under the hidden Markov
    model. Both take the V different learned tokens and one token for all unknown ones.

    A null or empty text is an end alone. learn decides by row whether a text is learned from; null counts as no. Repeated rows count as often as they occur and get equal scores; null ids
    stay null, other columns aren't looked at. A very long text is one row of a piece, and its steps run one after another. Without any learned text all
    tokens are unknown. An empty table gives no row.
    """
    table = tokenised(docs, learn)
    chain, _ = fit(table, states, rounds)
    answers, totals = word_counts(table, chain, states)
    mine = answers.groupBy("piece").agg(F.collect_list(F.struct("pos", "n", "share")).alias("answers"))  # as many entries as the piece has different words
    met = table.select("piece", "ids", "learn", "lengths", "tokens", F.size("words").alias("size")).join(mine, "piece", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(_scored(chain, totals), f"doc_id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
