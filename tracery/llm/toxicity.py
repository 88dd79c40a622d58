"""Toxicity by a weighted finite-state grammar of clauses.

A lexicon turns the words of a clause into symbols: insult, threat, target, negation, reported speech, other. Words
and stems that tell toxic documents from clean ones are learnt and join the insults, each with a weight. Three
transducers read the symbols one after the other and mark what they hold: reported speech to the clause's end,
negation over the next words, a target near an insult or a threat on either side. They are composed into one
machine, which labels each match with its pattern; matched clauses, not words, are scored: a logistic model weighs
what each pattern gathers in a document. Patterns that the labels never show keep their prior weights.

The lexicon and the model learn from a bounded sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, mix64, powers, shared_folder, staged, text_chunks

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words of each symbol in English, German, French and Spanish.
WORDS = {
    INSULT: "idiot idiots moron scum stupid loser losers pathetic worthless disgusting dumb fool vermin dummkopf arschloch abschaum versager imbécile connard ordure idiota imbécil estúpido basura".split(),
    THREAT: "kill hurt beat burn shoot stab destroy strangle töten umbringen verprügeln erschießen tuer frapper brûler matar golpear quemar".split(),
    TARGET: "you your you're u he she they him them these those du dich dein ihr euch tu toi vous ils elles tú usted ustedes ellos ellas".split(),
    NEGATION: "not never isn't aren't don't won't nobody nicht kein keine keiner niemals pas jamais aucun nunca jamás ningún".split(),
    REPORT: "said says wrote called calls quoted claimed according sagte nannte schrieb behauptet disait appelait écrit dijo llamó escribió".split(),
}
NEGATES, AIMS = 3, 4  # words that a negation reaches, and that lie between a target and what it is called
#: The mean number of labelled rows that is learnt from, and of characters where that is less.
SAMPLE, SAMPLE_CHARS = 8000, 1 << 25
#: A stem is a word's first letters, so many; a learnt entry stands in so many toxic documents, each of which COVER entries may explain.
STEMS, SUPPORT, COVER = range(4, 9), 5, 3
#: A learnt entry's documents are toxic with this probability at least, by Wilson's lower bound.
SURE, DEVIATIONS = 0.5, 2.0
PRIOR_WEIGHT, MOST_WEIGHT = 3.0, 6.0
#: Texts are read in pieces of about so many characters; a clause that is longer counts as several.
PIECE = 1 << 20
NEGATED, REPORTED, AIMED = 2, 4, 8
PATTERNS = ["+".join(["threat" if p & 1 else "insult", *(n for bit, n in ((NEGATED, "negated"), (REPORTED, "reported"), (AIMED, "aimed")) if p & bit)]) for p in range(16)]
LATE = 16  # a target that follows what it is called
#: Where a clause ends.
ENDS = np.isin(np.arange(128), [ord(c) for c in ".!?;:\n\r"])
FEATURES = LATE + 2  # patterns, late targets, matched weight for each word
RIDGE = 1e-3


class Transducer(NamedTuple):
    """A deterministic machine: step(state, symbol) gives the next state and the symbol that is passed on."""

    start: object
    step: object


def reporting() -> Transducer:
    """Marks all matches after a word of saying."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        kind = symbol & 7
        return (1 if kind == REPORT else state), symbol | (8 if state and kind in (INSULT, THREAT) else 0)

    return Transducer(0, step)


def negating() -> Transducer:
    """Marks a match in the words after a negation."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        kind = symbol & 7
        return (NEGATES if kind == NEGATION else max(state - 1, 0)), symbol | (16 if state and kind in (INSULT, THREAT) else 0)

    return Transducer(0, step)


def aiming() -> Transducer:
    """Marks a match near a target before it, and a target near a match before it."""

    def step(state: tuple[int, int], symbol: int) -> tuple[tuple[int, int], int]:
        (target, hit), kind = state, symbol & 7
        match = kind in (INSULT, THREAT)
        mark = 32 if (match and target) or (kind == TARGET and hit) else 0
        return (AIMS if kind == TARGET else max(target - 1, 0), AIMS if match else 0 if kind == TARGET else max(hit - 1, 0)), symbol | mark

    return Transducer((0, 0), step)


class Machine(NamedTuple):
    """moves and labels by state and symbol, and the state after so many other words. A label of -1 is no match."""

    moves: list[list[int]]
    labels: list[list[int]]
    after: list[list[int]]


def composed(*parts: Transducer) -> Machine:
    """One machine for transducers that read each other's output: its states are those that the product reaches."""
    start = tuple(p.start for p in parts)
    number, waiting, moves, labels = {start: 0}, [start], [], []
    while waiting:
        states = waiting.pop(0)
        row, told = [], []
        for symbol in range(6):
            out, following = symbol, []
            for part, state in zip(parts, states, strict=True):
                state, out = part.step(state, out)
                following.append(state)
            following = tuple(following)
            if following not in number:
                number[following] = len(number)
                waiting.append(following)
            row.append(number[following])
            if symbol in (INSULT, THREAT):
                told.append((symbol == THREAT) | (NEGATED if out & 16 else 0) | (REPORTED if out & 8 else 0) | (AIMED if out & 32 else 0))
            else:
                told.append(LATE if symbol == TARGET and out & 32 else -1)
        moves.append(row)
        labels.append(told)
    after = [list(range(len(moves)))]
    for _ in range(max(NEGATES, AIMS) + 1):  # then no further word changes anything
        after.append([moves[s][OTHER] for s in after[-1]])
    return Machine(moves, labels, after)


MACHINE = composed(reporting(), negating(), aiming())


class Lexicon(NamedTuple):
    """Sorted hashes of words and stems, the symbol of each and its weight."""

    hashes: np.ndarray
    symbols: np.ndarray
    weights: np.ndarray


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


class Tokens(NamedTuple):
    """Words of some pieces of text: first and next character, clause, and a function for the hashes of words or stems."""

    start: np.ndarray
    end: np.ndarray
    clause: np.ndarray
    hashes: object


def lowered(text: str) -> str:
    """Lower case, one character for each."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def tokens(text: str) -> Tokens:
    """Words are runs of letters, with apostrophes inside; clauses end at any of . ! ? ; : and at line ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2070)) & ~((codes >= 0x3000) & (codes < 0x3040)))
    if len(codes) > 2:
        quote = (codes[1:-1] == 0x27) | (codes[1:-1] == 0x2019)
        letter[1:-1] |= quote & letter[:-2] & letter[2:]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    clause = np.searchsorted(np.flatnonzero(ENDS[np.minimum(codes, 127)]), start)
    up = powers(len(codes) + 2)
    down = powers(len(codes) + 2, pow(int(up[1]), -1, 1 << 64))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])

    def hashes(which: np.ndarray, stem: int = 0) -> np.ndarray:
        """Of whole words, or of their first `stem` letters."""
        to = start[which] + stem if stem else end[which]
        return mix64((sums[to] - sums[start[which]]) * down[start[which]] + np.uint64(bool(stem)))

    return Tokens(start, end, clause, hashes)


def word_hash(word: str) -> int:
    return int(tokens(word).hashes(np.array([0]))[0])


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """Places and texts of pieces, cut after a clause if one ends in their last half, else after a word, else anywhere."""
    at = 0
    while len(text) - at > PIECE:
        part = text[at : at + PIECE]
        cut = max(part.rfind(c, PIECE // 2) for c in ".!?;:\n")
        cut = cut if cut >= 0 else part.rfind(" ", PIECE // 2)
        cut = PIECE if cut < 0 else cut + 1
        yield at, part[:cut]
        at += cut
    yield at, text[at:]


def symbols(found: Tokens, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The symbol and the weight of each word; of several entries that hold for it, that of most weight."""
    n = len(found.start)
    kind, weight = np.zeros(n, np.int8), np.zeros(n)
    if not len(lexicon.hashes):
        return kind, weight
    low = np.zeros(1 << 16, bool)  # most words are told apart by 16 bits
    low[lexicon.hashes & np.uint64(0xFFFF)] = True
    size = found.end - found.start
    for stem in (0, *STEMS):
        which = np.flatnonzero(size > stem)
        own = found.hashes(which, stem)
        maybe = low[own & np.uint64(0xFFFF)]
        which, own = which[maybe], own[maybe]
        at = np.minimum(np.searchsorted(lexicon.hashes, own), len(lexicon.hashes) - 1)
        hit = lexicon.hashes[at] == own
        which, at = which[hit], at[hit]
        better = (kind[which] == OTHER) | (lexicon.weights[at] > weight[which])
        kind[which[better]], weight[which[better]] = lexicon.symbols[at[better]], lexicon.weights[at[better]]
    return kind, weight


class Match(NamedTuple):
    """A matched clause: whose it is, its place in that text (end exclusive), its patterns, what it weighs."""

    text: int
    start: int
    end: int
    patterns: tuple[int, ...]
    weight: float


def joined(texts: list[str | None]) -> Iterator[tuple[str, list[int], list[int], list[int]]]:
    """Short texts put together and long ones cut to pieces, in lower case: the characters, and of each part its text, its first character there and here."""
    parts, owner, place, begin, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at, part in pieces(lowered(text or "")):
            if size and size + len(part) > PIECE:
                yield "\n".join(parts), owner, place, begin
                parts, owner, place, begin, size = [], [], [], [], 0
            parts.append(part)
            owner.append(i)
            place.append(at)
            begin.append(size)
            size += len(part) + 1
    if parts:
        yield "\n".join(parts), owner, place, begin


def matches(texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, list[tuple[int, int, float]], list[Match]]:
    """How many words each text has, all matches (text, label, weight), and the clauses that hold them."""
    n, events, found_clauses = np.zeros(len(texts), np.int64), [], []
    for blob, owner, place, begin in joined(texts):
        found, owner, shift, begin = tokens(blob), np.array(owner), np.array(place) - np.array(begin), np.array(begin)
        part = np.searchsorted(begin, found.start, side="right") - 1
        np.add.at(n, owner, np.bincount(part, minlength=len(owner)))
        kind, weight = symbols(found, lexicon)
        hit = (kind == INSULT) | (kind == THREAT)
        if not hit.any():
            continue
        own = np.flatnonzero((kind != OTHER) & np.isin(found.clause, np.unique(found.clause[hit])))
        at = shift[part[own]]
        before, state, last, seen = -1, 0, 0, []
        for i, c, t, k, w, s, e in zip(*(x.tolist() for x in (own, found.clause[own], owner[part[own]], kind[own], weight[own], found.start[own] + at, found.end[own] + at)), strict=True):
            if c != before:
                if seen:
                    found_clauses.append(seen)
                before, state, last, seen = c, 0, i - 1, []
            state = MACHINE.after[min(i - last - 1, len(MACHINE.after) - 1)][state]
            label = MACHINE.labels[state][k]
            state, last = MACHINE.moves[state][k], i
            if label >= 0:
                w = 1.0 if label == LATE else w
                events.append((t, label, w))
                seen.append((t, label, 0.0 if label == LATE else w, s, e))
        if seen:
            found_clauses.append(seen)
    return n, events, [Match(c[0][0], c[0][3], c[-1][4], tuple(x[1] for x in c), sum(x[2] for x in c)) for c in found_clauses]


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """What each pattern gathers in each text, on a logarithmic scale, and the weight of all for each hundred words."""
    n, events, _ = matches(texts, lexicon)
    out = np.zeros((len(texts), FEATURES))
    for text, label, weight in events:
        out[text, label] += weight
    out[:, -1] = 100 * out[:, :LATE].sum(1) / (n + 10)
    return np.log1p(out)


def prior() -> tuple[np.ndarray, float]:
    """Weights before any label is seen: negated and reported matches count for little, aimed ones and threats for more."""
    weights = np.array([(1.5 if p & 1 else 1.0) * (0.2 if p & NEGATED else 1) * (0.3 if p & REPORTED else 1) * (1.5 if p & AIMED else 1) for p in range(16)])
    return np.append(weights, [0.3, 0.5]), -2.5


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def weighed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's steps, with a ridge towards the prior weights."""
    weights, bias = prior()
    now = first = np.append(weights, bias)
    if len(set(y.tolist())) < 2:
        return weights, bias
    x = np.column_stack([x, np.ones(len(x))])
    loss = lambda w: np.mean(np.logaddexp(0, x @ w) - y * (x @ w)) + RIDGE / 2 * np.square(w - first).sum()
    for _ in range(50):
        p = logistic(x @ now)
        slope = x.T @ (p - y) / len(y) + RIDGE * (now - first)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + RIDGE * np.eye(len(now)), slope)
        size = 1.0
        while size > 1e-4 and loss(now - size * move) > loss(now):
            size /= 2
        now = now - size * move
        if np.abs(move).max() < 1e-8:
            break
    return now[:-1], float(now[-1])


def entries(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words a text has, and the hashes of its distinct words and stems with their numbers."""
    n, all_ = 0, []
    for _, part in pieces(lowered(text or "")):
        found = tokens(part)
        n += len(found.start)
        size = found.end - found.start
        all_ += [found.hashes(np.flatnonzero(size > stem), stem) for stem in (0, *STEMS)]
    values, counts = np.unique(np.concatenate(all_), return_counts=True)
    return n, values, counts


def lower_bound(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Wilson's lower bound of the share of toxic documents."""
    n, z = np.maximum(toxic + clean, 1e-9), DEVIATIONS
    p = toxic / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def chosen(doc: np.ndarray, entry: np.ndarray, toxic: np.ndarray, n_entries: int) -> np.ndarray:
    """Entries that cover the toxic documents, the most telling first, given pairs of documents and entries.

    A document that COVER chosen entries hold is explained and recommends no further one: so the odd words of a
    document with known insults, or of many copies of one, aren't taken for insults.
    """
    bad = toxic[doc]
    t, c = np.bincount(entry[bad], minlength=n_entries), np.bincount(entry[~bad], minlength=n_entries)
    sure = lower_bound(t, c)
    gain = np.log(np.maximum(sure, 1e-9) / max(toxic.mean(), 1e-9))
    able = (sure >= SURE) & (t >= SUPPORT) & (gain > 0)
    doc, entry = doc[bad & able[entry]], entry[bad & able[entry]]
    turn = np.argsort(entry, kind="stable")
    doc_of, begin = doc[turn], np.searchsorted(entry[turn], np.arange(n_entries + 1))
    held, out = np.zeros(len(toxic), np.int64), []
    while True:
        left = np.bincount(entry[held[doc] < COVER], minlength=n_entries)
        left[out] = 0
        best = int(np.argmax(np.where(able & (left >= SUPPORT), left * gain, -1)))
        if not able[best] or left[best] < SUPPORT:
            return np.array(sorted(out), np.int64)
        out.append(best)
        held[doc_of[begin[best] : begin[best + 1]]] += 1


def known() -> Lexicon:
    """The fixed words; insults and threats have the prior weight."""
    rows = sorted((word_hash(w), k, PRIOR_WEIGHT if k in (INSULT, THREAT) else 0.0) for k, ws in WORDS.items() for w in ws)
    return Lexicon(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int8), np.array([r[2] for r in rows]))


def fit(labelled: DataFrame) -> Model:
    """From columns text, toxic (0 or 1) and key, which seeds the choice of the sample. Rows without a label or a text teach nothing.

    Candidates are words and stems of toxic documents in the sample; each round over it returns bounded counts.
    """
    usable = labelled.where("text is not null and toxic in (0, 1)")
    n, chars = usable.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    share = min(1.0, SAMPLE / max(n, 1), SAMPLE_CHARS / max(chars or 0, 1))
    sample = usable.where(F.pmod(F.xxhash64("key", F.lit(12)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = staged(sample.select(F.col("key").cast("string").alias("key"), F.col("toxic").cast("int").alias("toxic"), "text"))
    send = sample.sparkSession.sparkContext.broadcast

    def told(of, shape: str, rows: DataFrame = sample) -> list:
        """of(text), a tuple, of all rows, in the same order at every run."""

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_chunks(batches):
                got = [of(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("toxic"), *map(pa.array, zip(*got, strict=True))], ["key", "toxic", *names])

        names = [x.split()[0] for x in shape.split(", ")]
        return sorted(rows.mapInArrow(each, f"key string, toxic int, {shape}").collect(), key=lambda r: (r.key or "", r.toxic, *map(bytes, r[2:])))

    base = known()
    found = told(lambda t: (entries(t)[1].tobytes(),), "own binary", sample.where("toxic = 1"))
    values, times = np.unique(np.concatenate([np.frombuffer(r.own, np.uint64) for r in found] or [np.empty(0, np.uint64)]), return_counts=True)
    values = values[times >= SUPPORT]
    values = values[~np.isin(values, base.hashes)] if len(values) else values
    candidates = send(np.union1d(values, base.hashes))

    def held(text: str) -> tuple[bytes, bytes, bytes]:
        n, own, counts = entries(text)
        at = np.minimum(np.searchsorted(candidates.value, own), len(candidates.value) - 1)
        hit = candidates.value[at] == own
        return np.int64(n).tobytes(), at[hit].astype(np.int32).tobytes(), counts[hit].astype(np.int64).tobytes()

    rows = told(held, "words binary, own binary, counts binary")
    rows = list({(r.toxic, bytes(r.words), bytes(r.own), bytes(r.counts)): r for r in rows}.values())  # copies are told once
    size = len(candidates.value)
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    own = [np.frombuffer(r.own, np.int32) for r in rows]
    doc, entry = np.repeat(np.arange(len(rows)), [len(x) for x in own]), np.concatenate([*own, np.empty(0, np.int32)]).astype(np.int64)
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows] + [np.empty(0, np.int64)])
    words = np.array([np.frombuffer(r.words, np.int64)[0] for r in rows], np.float64)
    lexicon = base
    if toxic.any() and not toxic.all():
        picked = chosen(doc, entry, toxic, size)
        bad = toxic[doc]
        rate = lambda which, all_: (np.bincount(entry[which], counts[which], minlength=size), max(all_.sum(), 1.0))
        (t, t_words), (c, c_words) = rate(bad, words[toxic]), rate(~bad, words[~toxic])
        # Fixed words start from their prior weight, which counts as one word in each kind of text does.
        learnt = lambda prior: np.clip(np.log((t + 0.5 * np.exp(prior)) / t_words) - np.log((c + 0.5) / c_words), 0, MOST_WEIGHT)
        weights = {int(candidates.value[i]): (INSULT, float(w)) for i, w in zip(picked, learnt(0.0)[picked], strict=True)}
        mine = np.searchsorted(candidates.value, base.hashes)
        for h, k, w in zip(base.hashes.tolist(), base.symbols.tolist(), learnt(PRIOR_WEIGHT)[mine].tolist(), strict=True):
            if k not in (INSULT, THREAT):
                weights[h] = (k, 0.0)
            elif w > 0.5 or h in weights:  # a fixed word that clean texts have as often is none here
                weights[h] = (k, max(w, weights.get(h, (k, 0.0))[1]))
        at = sorted(weights)
        lexicon = Lexicon(np.array(at, np.uint64), np.array([weights[h][0] for h in at], np.int8), np.array([weights[h][1] for h in at]))
    sent = send(lexicon)
    rows = told(lambda t: (features([t], sent.value)[0].tobytes(),), "x binary")
    x = np.array([np.frombuffer(r.x, np.float64) for r in rows]).reshape(-1, FEATURES)
    weights, bias = weighed(x, np.array([r.toxic for r in rows], np.float64))
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns `keep` and score of every row, from its whole text alone; null counts as empty. A kept column of that name gets an underscore after it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own, kept = keeping(docs, keep, {"__text": F.col("text").cast("string")}, ["score"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights, bias = sent.value
        for part in text_chunks(batches, "__text"):
            x = features(part.column("__text").to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(logistic(x @ weights + bias))], [*kept, "score"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(rows, f"{shape}, score double")


def clauses(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns `keep` with start, end (characters, exclusive), patterns (in order) and weight of every matched clause, from its first match to its last."""
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    own, kept = keeping(docs, keep, {"__text": F.col("text").cast("string")}, ["start", "end", "patterns", "weight"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "__text"):
            flat = matches(part.column("__text").to_pylist(), sent.value)[2]
            row = pa.array([m.text for m in flat], pa.int64())
            names = [[PATTERNS[p] if p < LATE else "target" for p in m.patterns] for m in flat]
            cells = [pa.array([m.start for m in flat], pa.int64()), pa.array([m.end for m in flat], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([m.weight for m in flat], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(len(kept))), *cells], [*kept, "start", "end", "patterns", "weight"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(rows, f"{shape}, start long, end long, patterns array<string>, weight double")


def held_out(key: Column) -> Column:
    """True for the documents that learning never sees: crc32 of the id's text is divisible by 5. Null counts as seen."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_of(docs: DataFrame, labels: DataFrame) -> Model:
    """The sample is drawn from the labels before their texts are fetched, so that only bounded rows meet the documents."""
    rated = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    few = rated.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(13)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(rated.count(), 1)) * (1 << 30)))
    own = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    # Written first, so that the documents are read once for it.
    both = own.join(F.broadcast(few.select(F.col("doc_id").cast("long").alias("key"), "toxic")), "key")
    return fit(staged(both, shared_folder(docs.sparkSession)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that aren't held out. Repeated rows each get a result."""
    out = score(docs, model_of(docs, labels), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
