"""SentencePiece encoding with sampled segmentations, and decoding.

Gumbel top-k without replacement: a best-first (A*) search over the lattice of a text's segmentations. A node of the search
is a set of segmentations (decisions fixed so far, one decision barred from what was taken before) and its priority is the
set's greatest perturbed log probability, known exactly from the lattice's forward sums; the best set gives the next
segmentation, and what is left of it is split by the first decision in which it differs.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import batch_of, mix, modest_batches, per_batch, tidy

SPACE = "▁"
FACTOR = 0x9E3779B97F4A7C15  # of the polynomial hash of pieces


@dataclass(frozen=True)
class Sampling:
    """Segmentations of each text, sharpness of the piece distribution (the exponent on 1 / (1 + rank)), and the seed."""

    samples: int = 2
    sharpness: float = 1.0
    seed: int = 0


class Lattices:
    """Lattices of units, remembered. A unit is a run of spaces and what follows it up to the next space: no piece of the
    vocabulary crosses its ends, so a text's lattice is the chain of its units'. A piece of rank r weighs 1 / (1 + r); a
    character without a piece of its own is spelt in bytes.

    Flat arrays over all nodes and edges: an edge ends at its node; ``bound`` is the node's number plus the cumulative
    probability of its edges, so a number above the node's own draws an edge."""

    EDGES, MET = 4_000_000, 300_000

    def __init__(self, model: str, sharpness: float) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(k) for k in range(n)]
        own = [k for k in range(n) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k))]
        self.weight = {self.pieces[k]: (k, -sharpness * math.log1p(min(-self.model.get_score(k), 1e6))) for k in own}
        self.longest = max(map(len, self.weight))
        self.byte = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if self.model.is_byte(k)}
        self.ascii = np.array([self.byte[b] for b in range(0x80)], np.int64)
        self.byte_cost = -sharpness * math.log(n) - 10.0
        self.split = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.tables = []  # by length of a piece: sorted hashes, ids, weights
        for n in range(1, self.longest + 1):
            own = sorted((int(self.hashed(p)), *self.weight[p]) for p in self.weight if len(p) == n)
            keys = np.array([x[0] for x in own], np.uint64)
            seen = np.zeros(1 << 18, bool)  # by the high bits: most substrings are no piece, and need no search
            seen[(keys >> np.uint64(46)).astype(np.int64)] = True
            self.tables.append((keys, np.array([x[1] for x in own], np.int32), np.array([x[2] for x in own]), seen))
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.clear()

    @staticmethod
    def hashed(piece: str) -> np.uint64:
        out = 0
        for k, c in enumerate(reversed(piece)):
            out += (ord(c) + 1) * pow(FACTOR, k, 1 << 64)
        return np.uint64(out % (1 << 64))

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.met: set[str] = set()
        self.first, self.last = array("q"), array("q")  # nodes of a unit
        self.nodes = self.edges = 0
        self.mark, self.passing = (0, 0, 0), []
        self.begin = np.zeros(1 << 16, np.int64)  # first edge of a node
        self.held = [np.zeros(1 << 16, t) for t in (np.float64, np.float64, np.int32, np.int32)]  # bound, chance, piece, back

    def __getitem__(self, unit: str) -> int:
        """The number of a unit, given with its first space."""
        if unit[1:] not in self.units:
            self.learn([unit[1:]])
        return self.units[unit[1:]]

    def prepare(self, wanted: set[str]) -> None:
        """Makes the lattices of these units available. Most units occur once: one that is met for the first time is given
        back after the step, one that is met again is remembered."""
        if self.passing:
            for unit in self.passing:
                del self.units[unit]
            self.nodes, self.edges, kept = self.mark
            del self.first[kept:], self.last[kept:]
            if len(self.met) > self.MET:
                self.met.clear()
            self.met.update(self.passing)
            self.passing = []
        if self.edges > self.EDGES:
            self.clear()
        new = wanted - self.units.keys()
        again = new & self.met
        self.met -= again
        self.learn(list(again))
        self.mark, self.passing = (self.nodes, self.edges, len(self.first)), list(new - again)
        self.learn(self.passing)

    def learn(self, units: list[str]) -> None:
        """Builds the lattices of new units, many at once. A unit is named without its first space, which all of them have."""
        short, long_ = sorted((u for u in units if len(u) < 64), key=len, reverse=True), [u for u in units if len(u) >= 64]
        if short:
            self._learn_many(short)
        for unit in long_:
            self._learn_one(unit)

    def _learn_many(self, units: list[str]) -> None:
        """Units in order of falling length, position by position: a position has the first of them, so what their
        substrings' hashes and forward sums need lies side by side."""
        codes = np.frombuffer((SPACE + SPACE.join(units)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array(list(map(len, units)), np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        powers, inverses = self.powers_to(int(sizes[0]))
        hashed, forward, out = [np.zeros(len(units), np.uint64)], [np.zeros(len(units))], []
        for k in range(1, int(sizes[0]) + 1):
            m, reach = int(np.searchsorted(-sizes, -k, "right")), min(k, self.longest)
            here = codes[starts[:m] + k - 1]
            hashed.append(hashed[-1][:m] + (here + np.uint64(1)) * inverses[k - 1])
            came, pieces = np.full((reach, m), -np.inf), np.empty((m, reach), np.int32)
            for n in range(1, reach + 1):
                keys, piece, weight, seen = self.tables[n - 1]
                if not len(keys):
                    continue
                h = (hashed[k] - hashed[k - n][:m]) * powers[k - 1]
                may = np.flatnonzero(seen[(h >> np.uint64(46)).astype(np.int64)])
                found = np.minimum(np.searchsorted(keys, h[may]), len(keys) - 1)
                hit = keys[found] == h[may]
                own, found = may[hit], found[hit]
                came[n - 1, own], pieces[own, reach - n] = weight[found] + forward[k - n][own], piece[found]
                if n == 1:
                    lost = np.flatnonzero(came[0] == -np.inf)
                    cost, pieces[lost, reach - 1] = self.spelt(here[lost])
                    came[0, lost] = cost + forward[k - 1][lost]
            top = came.max(0)
            forward.append(top + np.log(np.exp(came - top).sum(0)))
            chances = (came - forward[-1])[::-1].T.ravel()  # longer pieces first: they tend to be likely, so a draw seldom looks further
            kept = np.flatnonzero(chances > -np.inf)
            own = kept // reach
            out.append((own, np.full(len(own), k), chances[kept], pieces.ravel()[kept], k - reach + kept % reach))
        self.store(units, sizes, *map(np.concatenate, zip(*out, strict=True)))

    def _learn_one(self, unit: str) -> None:
        """One long unit: all its substrings' hashes at once, forward sums position by position."""
        codes = np.frombuffer((SPACE + unit).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total = len(codes)
        powers, inverses = self.powers_to(total)
        sums = np.cumsum(np.r_[np.uint64(0), (codes + np.uint64(1)) * inverses[:total]], dtype=np.uint64)
        weights, pieces = np.full((total, self.longest), -np.inf), np.zeros((total, self.longest), np.int32)
        for n, (keys, piece, weight, seen) in enumerate(self.tables, 1):
            if not len(keys):
                continue
            h = (sums[n:] - sums[:-n]) * powers[n - 1 : total]
            may = np.flatnonzero(seen[(h >> np.uint64(46)).astype(np.int64)])
            found = np.minimum(np.searchsorted(keys, h[may]), len(keys) - 1)
            hit = keys[found] == h[may]
            end, found = may[hit] + n - 1, found[hit]
            weights[end, self.longest - n], pieces[end, self.longest - n] = weight[found], piece[found]
        lost = np.flatnonzero(weights[:, -1] == -np.inf)
        weights[lost, -1], pieces[lost, -1] = self.spelt(codes[lost])
        forward = np.full(total + self.longest, -np.inf)
        forward[self.longest - 1] = 0.0
        for k in range(total):
            came = weights[k] + forward[k : k + self.longest]
            top = came.max()
            forward[k + self.longest] = top + math.log(np.exp(came - top).sum())
            weights[k] = came - forward[k + self.longest]
        kept = np.flatnonzero(weights.ravel() > -np.inf)
        node = kept // self.longest + 1
        self.store([unit], np.array([total]), np.zeros(len(kept), np.int64), node, weights.ravel()[kept], pieces.ravel()[kept], node - self.longest + kept % self.longest)

    def powers_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the hash's factor and of its inverse. A prefix's sum of codes times inverse powers, less that of a
        shorter prefix, is the hash of what lies between them, but for a power."""
        if len(self.powers) < n:
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, f, np.uint64)], dtype=np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        return self.powers, self.inverses

    def spelt(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of characters without a piece of their own, and the byte's piece or, of several bytes, a mark."""
        c = codes.astype(np.int64)
        return self.byte_cost * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)), np.where(c < 0x80, self.ascii[np.minimum(c, 0x7F)], -1 - c)

    def store(self, units: list[str], sizes: np.ndarray, own: np.ndarray, place: np.ndarray, chance: np.ndarray, piece: np.ndarray, back: np.ndarray) -> None:
        """Keeps edges, those that end at one node side by side: the unit, the place that they end at, and where they begin."""
        base = self.nodes + np.cumsum(sizes) - sizes + np.arange(len(units))
        node = base[own] + place
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        each = np.exp(chance)
        run = np.cumsum(each)
        run = np.minimum(run - np.repeat(run[heads] - each[heads], np.diff(np.r_[heads, len(node)])), 1.0)
        run[np.r_[heads[1:], len(node)] - 1] = 1.0
        while self.edges + len(node) > len(self.held[0]):
            self.held = [np.concatenate([x, np.zeros_like(x)]) for x in self.held]
        for kept, new in zip(self.held, (node + run, chance, piece, back), strict=True):
            kept[self.edges : self.edges + len(node)] = new
        grown = self.nodes + int(sizes.sum()) + len(units)
        while grown > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.begin[node[heads]] = self.edges + heads
        self.edges += len(node)
        self.nodes = grown
        self.units.update(zip(units, range(len(self.first), len(self.first) + len(units)), strict=True))
        self.first.frombytes(base.astype(np.int64).tobytes())
        self.last.frombytes((base + sizes).astype(np.int64).tobytes())

    def arrays(self) -> tuple[np.ndarray, ...]:
        return *(x[: self.edges] for x in self.held), np.array(self.first), np.array(self.last), self.begin


def uniform(seed: np.ndarray, at: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed, the place in its text and the purpose alone."""
    with np.errstate(over="ignore"):
        x = mix(seed + at.astype(np.uint64) * np.uint64(FACTOR) + np.asarray(salt, np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


#: Purposes of random numbers: a number is used for one of them alone. Those of a split set come three for each split.
MASS, FIRST, SCORES, BRANCH, TAIL = 1, 2, 0, 1, 2


def salt_of(split: int, purpose: int) -> int:
    return 3 + 3 * split + purpose


def row_seed(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}".encode())


def draw(a: tuple[np.ndarray, ...], unit: np.ndarray, state: np.ndarray, place: np.ndarray, seed: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws the edges of unit occurrences from ``state`` (a node) back to the unit's start: (edges of all occurrences one
    after another, each in the order drawn; how many each has)."""
    bound, _, _, back, first, _, begin = a
    n, rounds, start = np.zeros(len(unit), np.int64), [], first[unit]
    alive = np.flatnonzero(state > start)
    state = state.copy()
    while len(alive):
        here = state[alive]
        target = here + uniform(seed[alive], place[alive] + here - start[alive], salt[alive])
        edge = begin[here]
        more = np.flatnonzero(bound[edge] <= target)
        while len(more):
            edge[more] += 1
            more = more[bound[edge[more]] <= target[more]]
        rounds.append((alive, edge))
        n[alive] += 1
        state[alive] = start[alive] + back[edge]
        alive = alive[state[alive] > start[alive]]
    begin = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    for k, (who, edge) in enumerate(rounds):
        out[begin[who] + k] = edge
    return out, n


def gumbel(location: np.ndarray, u: np.ndarray, limit: float) -> np.ndarray:
    """Greatest perturbed values of sets with these log masses, given that none exceeds the limit."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-limit, -(location - np.log(-np.log(u))))


@dataclass
class Sample:
    edges: np.ndarray
    counts: np.ndarray  # edges of each unit
    log_prob: float
    score: float
    inclusion: float = 0.0


def samples_of(a: tuple[np.ndarray, ...], units: np.ndarray, places: np.ndarray, seed: int, k: int) -> list[Sample]:
    """At most k distinct segmentations of one text, by falling perturbed score; fewer if the text has no more."""
    return searches(a, [(units, places, seed)], k)[0]


def searches(a: tuple[np.ndarray, ...], texts: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> list[list[Sample]]:
    """The searches of several texts (units, their places, seed), step by step together: what they ask for is drawn at once."""
    runs = [search(a, *text, k) for text in texts]
    out: list[list[Sample]] = [[] for _ in runs]
    asked = {n: next(run) for n, run in enumerate(runs)}
    while asked:
        parts = list(asked.values())
        n = [len(p[0]) for p in parts]
        seeds, salts = (np.repeat(np.array([p[i] for p in parts], np.uint64), n) for i in (3, 4))
        edges, counts = draw(a, *(np.concatenate([p[i] for p in parts]) for i in range(3)), seeds, salts)
        stops, cut, then = np.r_[0, np.cumsum(counts)], 0, {}
        for number, size in zip(asked, n, strict=True):
            try:
                then[number] = runs[number].send((edges[stops[cut] : stops[cut + size]], counts[cut : cut + size]))
            except StopIteration as end:
                out[number] = end.value
            cut += size
        asked = then
    return out


def search(a: tuple[np.ndarray, ...], units: np.ndarray, places: np.ndarray, seed: int, k: int) -> Generator:
    """One text's search: yields what is to be drawn (units, states, places, seed, salt), is sent the edges, returns samples."""
    _, chance, _, _, _, ends, _ = a
    mass = float(-np.log(-np.log(uniform(np.array([seed], np.uint64), np.zeros(1, np.int64), MASS))[0]))
    drawn = yield units, ends[units], places, seed, FIRST
    if not len(units):
        return [Sample(*drawn, 0.0, mass, 1.0)]
    out: list[Sample] = []
    queue: list[tuple] = [(-mass, 0, None)]
    made = 0
    while queue and len(out) < k:
        score, _, held = heapq.heappop(queue)
        barred: tuple[int, ...] = ()
        if held is None:
            edges, counts, at = *drawn, 0
        else:
            old, at, barred = held
            edges, counts = yield from redraw(a, units, places, seed, old, at, barred, made)
        log_p = chance[edges]
        before = np.cumsum(log_p) - log_p
        sample = Sample(edges, counts, float(before[-1] + log_p[-1]), -score)
        out.append(sample)
        # what is left of the set: it parts from this segmentation at one of the decisions from ``at`` on
        free = -np.expm1(log_p[at:])
        if barred:  # the first of them is barred from more
            free[0] = max(0.0, 1.0 - sum(math.exp(chance[e]) for e in (*barred, edges[at])))
        with np.errstate(divide="ignore"):
            masses = before[at:] + np.log(free)
        steps = at + np.flatnonzero(free > 1e-12)
        if len(steps):
            made += 1
            scores = gumbel(masses[steps - at], uniform(np.full(len(steps), seed, np.uint64), steps, salt_of(made, SCORES)), -score)
            most = k - len(out) + 1  # no more can come to be drawn, and one more sets the bound
            best = np.arange(len(scores)) if len(scores) <= most else np.argpartition(-scores, most - 1)[:most]
            best = best[np.argsort(-scores[best], kind="stable")]
            for t in best.tolist():
                step = int(steps[t])
                bars = (*barred, int(edges[step])) if step == at and barred else (int(edges[step]),)
                heapq.heappush(queue, (-float(scores[t]), made * 1_000_000_000 + step, (sample, step, bars)))
    limit = -queue[0][0] if queue else -math.inf
    for sample in out:
        sample.inclusion = 1.0 if limit == -math.inf else float(-np.expm1(-np.exp(min(sample.log_prob - limit, 50.0))))
    return out


def redraw(a: tuple[np.ndarray, ...], units: np.ndarray, places: np.ndarray, seed: int, old: Sample, at: int, barred: tuple[int, ...], salt: int) -> Generator:
    """A segmentation that takes the old one's decisions before ``at``, none of the barred edges there, and what it likes
    after that."""
    bound, chance, _, back, starts, ends, begins = a
    begin = np.cumsum(old.counts) - old.counts
    unit = int(np.searchsorted(begin, at, "right")) - 1
    while old.counts[unit] == 0:
        unit -= 1
    start = int(starts[units[unit]])
    inner = old.edges[begin[unit] : at]
    node = start + int(back[inner[-1]]) if len(inner) else int(ends[units[unit]])
    low = high = int(begins[node])
    while bound[high] < node + 1.0:
        high += 1
    high += 1
    choice = np.array([e for e in range(low, high) if e not in barred])
    weights = np.cumsum(np.exp(chance[choice]))
    u = uniform(np.array([seed], np.uint64), np.array([at]), salt_of(salt, BRANCH))[0]
    edge = int(choice[min(int(np.searchsorted(weights, u * weights[-1], "right")), len(choice) - 1)])
    state = ends[units[unit:]].copy()
    state[0] = start + int(back[edge])
    tail, n = yield units[unit:], state, places[unit:], seed, salt_of(salt, TAIL)
    edges = np.concatenate([old.edges[:at], [edge], tail])
    counts = np.concatenate([old.counts[:unit], n])
    counts[unit] += len(inner) + 1
    return edges, counts


def ids_of(a: tuple[np.ndarray, ...], sample: Sample, lattices: Lattices) -> np.ndarray:
    """Piece ids in the order of the text; characters without a piece as their bytes."""
    return next(ids_of_all(a, [sample], lattices))


def ids_of_all(a: tuple[np.ndarray, ...], samples: list[Sample], lattices: Lattices) -> Iterator[np.ndarray]:
    """The piece ids of each sample, from one look-up for all of them."""
    counts, edges = (np.concatenate([getattr(s, f) for s in samples]) if samples else np.empty(0, np.int64) for f in ("counts", "edges"))
    ends = np.cumsum(counts)
    turned = np.repeat(2 * ends - counts - 1, counts) - np.arange(len(edges))
    every, at = a[2][edges[turned]], 0
    for s in samples:
        ids = every[at : at + len(s.edges)]
        at += len(s.edges)
        if len(ids) and ids.min() < 0:
            ids = np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [lattices.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")])], np.int32)
        yield ids


def text_units(text: str, lattices: Lattices) -> list[str]:
    """The units of a text, each without its first space: its words (the text's first word has a space before it too);
    more spaces in a row belong to the unit that they begin."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [unit[1:] for unit in lattices.split(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def decode_ids(ids: list[int], model) -> str:
    """The text of piece ids, with byte pieces put together."""
    return model.decode(ids) if ids else ""


FIELDS = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, score double, inclusion double"


def sampled_segmentations(docs: DataFrame, model: str, spec: Sampling | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, sample`` (from 0, by falling perturbed score), ``n_pieces, ids_crc32, log_prob, score, inclusion``, and
    ``ids`` if asked for. ``inclusion`` is the probability that the segmentation is among the first k, given the bound
    that the (k+1)-th sets; it is 1 where a text has no more segmentations.

    A null or empty text has one segmentation, without pieces. The row's key and the seed decide the samples, whatever
    partition a row lies in; equal rows get equal samples. Texts are read whole; an empty table gives no rows; other
    columns are ignored. U+2581 in a text counts as a space, as in the vocabulary's own normaliser."""
    spec = spec or Sampling()
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), *((c, pa.float64()) for c in ("log_prob", "score", "inclusion")), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # the memo's many small objects are no garbage
        lattices = Lattices(model, spec.sharpness)
        for batch in per_batch(batches, 256, 1 << 20):
            parts = [text_units(text or "", lattices) for text in batch.column("text").to_pylist()]
            lattices.prepare(set().union(*parts))
            docs_ = [(doc_id, np.fromiter(map(lattices.units.__getitem__, own), np.int64, len(own))) for doc_id, own in zip(batch.column("doc_id").to_pylist(), parts, strict=True)]
            a = lattices.arrays()
            sizes = np.array([len(u) for _, u in docs_])
            units = np.concatenate([u for _, u in docs_])
            length = a[5][units] - a[4][units] + 1
            ends = np.cumsum(length)
            cut = np.cumsum(sizes)
            skip = np.r_[0, ends][np.r_[0, cut[:-1]]]
            places = ends - length - np.repeat(skip, sizes)
            cuts = np.r_[0, cut]
            texts = [(own, places[cuts[k] : cuts[k + 1]], row_seed(i, spec.seed)) for k, (i, own) in enumerate(docs_)]
            made = [(doc_id, number, s) for (doc_id, _), found in zip(docs_, searches(a, texts, spec.samples), strict=True) for number, s in enumerate(found)]
            rows = []
            for (doc_id, number, s), ids in zip(made, ids_of_all(a, [x[2] for x in made], lattices), strict=True):
                rows.append((doc_id, number, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), s.log_prob, s.score, s.inclusion, *([ids.tolist()] if with_ids else [])))
            yield batch_of(schema, zip(*rows, strict=True))
        gc.enable()

    return modest_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), FIELDS + (", ids array<int>" if with_ids else ""))


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, sample, text`` of rows with ``ids``: the inverse of the encoding (U+2581 comes back as a space)."""
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in per_batch(batches, 128):
            yield batch_of(schema, (batch.column("doc_id"), batch.column("sample"), [decode_ids(x or [], own) for x in batch.column("ids").to_pylist()]))

    return encoded.select("doc_id", "sample", "ids").mapInArrow(tidy(run), "doc_id long, sample int, text string")
