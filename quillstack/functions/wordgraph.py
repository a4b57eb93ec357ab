"""Scores of words from the word graph of each document, and the phrases they rank.

Documents come as strings of words, one line for each sentence, in Arrow batches. The
graphs of a batch are held as one block-diagonal edge list. Phrases are put in order in the
same pass, so that no array of scores goes back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAMPING, ROUNDS = 0.85, 30
ROWS_AT_ONCE = 1_024
#: Links that go look for thirds among so many cells of the table of links at a time.
CELLS_AT_ONCE = 1 << 20
#: Bytes of words that are scored together, in whole documents: some 300,000 tokens.
BYTES_AT_ONCE = 1 << 20
#: Pairs of kinds that are linked together, and wedges (two links of one kind) with cells of
#: a table of links that are closed and peeled together, both in whole documents; a document
#: with more pairs or wedges than the second number of each is peeled alone, in its table.
PAIRS_AT_ONCE, MOST_PAIRS = 1 << 19, 1 << 22
WEDGES_AT_ONCE, MOST_WEDGES = 1 << 21, 1 << 23
#: A wider table of links is not made; links are searched then.
MOST_CELLS = 1 << 24
_STAYS = np.iinfo(np.int32).max
_PHRASES = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("score", T.DoubleType())]))
_STORED = pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64())]))
#: Scores are compared and given to so many places.
PLACES = 9


class _Stream:
    """Tokens of a batch: document, sentence and node number of each candidate."""

    def __init__(self, words: pa.ListArray, sentences: pa.ListArray):
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        self.nulls = words.is_null()
        flat = words.flatten()
        doc = np.repeat(np.arange(len(counts)), counts)
        coded = pc.dictionary_encode(flat)
        order = pc.rank(coded.dictionary, tiebreaker="first").to_numpy(zero_copy_only=False) - 1
        self.place = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
        codes = coded.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        keys = doc[self.place] * max(len(order), 1) + (order[codes] if len(order) else codes)
        nodes, self.node = np.unique(keys, return_inverse=True)
        self.n = len(nodes)
        self.doc = doc[self.place]
        self.words = flat.drop_null()
        self.sentence = sentences.flatten().to_numpy(zero_copy_only=False)[self.place]
        self.node_doc = np.zeros(self.n, dtype=np.int64)
        self.node_doc[self.node] = self.doc


def _pieces(lines: pa.StringArray) -> Iterator[pa.StringArray]:
    """Whole documents of about BYTES_AT_ONCE at a time: memory does not grow with the rows
    of an Arrow batch."""
    sizes = pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BYTES_AT_ONCE, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(sizes))):
        yield lines.slice(a, b - a)


def _opened(lines: pa.StringArray) -> tuple[pa.ListArray, pa.ListArray]:
    """The words of each document, null where there is none, and their sentence numbers."""
    texts = pc.split_pattern(lines, "\n")
    sentences = pc.split_pattern(texts.flatten(), " ")
    tokens = sentences.flatten()
    counts = pc.list_value_length(sentences).to_numpy(zero_copy_only=False)
    held = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    bounds = np.append(0, np.cumsum(held))
    offsets = pa.array(np.append(0, np.cumsum(counts))[bounds], pa.int32())
    number = np.repeat(np.arange(bounds[-1]) - np.repeat(bounds[:-1], held), counts)
    words = pc.if_else(pc.equal(tokens, ""), pa.scalar(None, tokens.type), tokens)
    return tuple(pa.ListArray.from_arrays(offsets, x, mask=lines.is_null()) for x in (words, pa.array(number, pa.int32())))


def half_up(x: np.ndarray) -> np.ndarray:
    """Numbers from zero on to PLACES places as decimals round, halves away from zero."""
    scaled = x * 10.0**PLACES
    low = np.floor(scaled)
    out = np.where(scaled - low < 0.5, low, low + 1) / 10.0**PLACES
    # The decimals decide where the product may be on the wrong side of the half.
    step = Decimal(1).scaleb(-PLACES)
    for i in np.flatnonzero((np.abs(scaled - low - 0.5) < np.maximum(1e-3, 4 * np.spacing(scaled)))):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP))
    return out


class _Runs:
    """The longest runs of candidates in one sentence, and their words as one phrase."""

    def __init__(self, stream: _Stream):
        go_on = np.diff(stream.place) == 1
        go_on &= (np.diff(stream.doc) == 0) & (np.diff(stream.sentence) == 0)
        self.first = np.flatnonzero(np.append(True, ~go_on)[:len(stream.place)])
        self.length = np.diff(np.append(self.first, len(stream.place)))
        self.doc = stream.doc[self.first]
        offsets = pa.array(np.append(self.first, len(stream.place)), pa.int32())
        coded = pc.dictionary_encode(pc.binary_join(pa.ListArray.from_arrays(offsets, stream.words), " "))
        self.phrases = coded.dictionary
        rank = pc.rank(self.phrases, tiebreaker="first").to_numpy(zero_copy_only=False)
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.rank = rank[self.code] if len(rank) else self.code

    def totals(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each run, from the first word on."""
        out = np.zeros(len(self.first))
        order = np.argsort(-self.length, kind="stable")
        longer = np.searchsorted(-self.length[order], -np.arange(self.length.max(initial=0)), "left")
        for at, n in enumerate(longer):
            out[order[:n]] += per_word[self.first[order[:n]] + at]
        return out

    def best(self, scores: np.ndarray, rows: int, most: int | None) -> pa.ListArray:
        """The phrases of each document as ``_STORED``, high scores first and equal ones in
        the order of their bytes; ``most`` of them where it is given. Equal phrases have
        equal words and so equal scores, and stand next to each other."""
        scores = half_up(scores)
        order = np.lexsort((self.rank, -scores, self.doc))
        doc, score, code = self.doc[order], scores[order], self.code[order]
        new = (doc[1:] != doc[:-1]) | (score[1:] != score[:-1]) | (code[1:] != code[:-1])
        kept = np.flatnonzero(np.append(True, new)[:len(doc)])
        counts = np.bincount(doc[kept], minlength=rows)
        if most is not None:
            kept = kept[np.arange(len(kept)) - np.repeat(np.cumsum(counts) - counts, counts) < most]
            counts = np.minimum(counts, most)
        values = pa.StructArray.from_arrays([self.phrases.take(pa.array(code[kept])), pa.array(score[kept])], ["phrase", "score"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


#: How the words of the nodes of a stream are scored: one number for each of its words.
Scorer = Callable[[_Stream], np.ndarray]
#: The score of a phrase from the sum of its words and their number.
PhraseScore = Callable[[np.ndarray, np.ndarray], np.ndarray]


def ranked_phrases(lines: Column, ways: Mapping[str, tuple[Scorer, PhraseScore]], most: int | None = None) -> Column:
    """For each of ``ways`` the phrases of a document as ARRAY<STRUCT<phrase, score>>, best
    first, in one struct; empty where there are no words. ``lines`` has a line for each
    sentence, blanks between its words, and nothing in place of tokens that are no
    candidates. The optimiser neither copies nor moves the function."""
    kind = T.StructType([T.StructField(name, _PHRASES) for name in ways])

    def piece(lines: pa.StringArray) -> pa.StructArray:
        stream = _Stream(*_opened(lines))
        runs = _Runs(stream)
        lists = [runs.best(phrase(runs.totals(word(stream)), runs.length), len(lines), most) for word, phrase in ways.values()]
        return pa.StructArray.from_arrays(lists, list(ways))

    def run(lines: pa.Array) -> pa.Array:
        return pa.chunked_array([piece(p) for p in _pieces(lines)], pa.struct([(name, _STORED) for name in ways])).combine_chunks()

    return F.arrow_udf(run, kind).asNondeterministic()(lines)


def _edges(stream: _Stream, look_back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Undirected edges between candidates up to ``look_back`` tokens apart in one
    sentence, in both directions, with their number of co-occurrences."""
    pairs = []
    for gap in range(1, look_back + 1):
        near = np.flatnonzero(
            (stream.place[gap:] - stream.place[:-gap] <= look_back)
            & (stream.doc[gap:] == stream.doc[:-gap])
            & (stream.sentence[gap:] == stream.sentence[:-gap])
        )
        a, b = stream.node[near], stream.node[near + gap]
        pairs.append(np.stack([a, b], axis=1)[a != b])
    both = np.concatenate(pairs)
    both = np.concatenate([both, both[:, ::-1]])
    keys, counts = np.unique(both[:, 0] * max(stream.n, 1) + both[:, 1], return_counts=True)
    return keys // max(stream.n, 1), keys % max(stream.n, 1), counts.astype(float)


def page_rank(look_back: int, weighted: bool) -> Scorer:
    """PageRank of each candidate in the word graph of its own document."""

    def scored(stream: _Stream) -> np.ndarray:
        u, v, weight = _edges(stream, look_back)
        if not weighted:
            weight = np.ones(len(weight))
        degree = np.bincount(u, weight, minlength=stream.n)
        base = (1 - DAMPING) / np.bincount(stream.node_doc)[stream.node_doc]
        share = weight / degree[u]
        rank = base / (1 - DAMPING)
        for _ in range(ROUNDS):
            rank = base + DAMPING * np.bincount(v, rank[u] * share, minlength=stream.n)
        return rank[stream.node]

    return scored


def _paths(graph: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of words that are linked to both, for some rows of kinds and all kinds."""
    out = np.empty((len(rows), len(graph)), np.float32)
    for start in range(0, len(rows), ROWS_AT_ONCE):
        some = graph[rows[start:start + ROWS_AT_ONCE]] * sizes
        out[start:start + ROWS_AT_ONCE] = some @ graph
    return out


def _truss(graph: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Largest k of a k-truss that holds a word of each kind.

    ``graph`` links kinds of words, ``sizes`` counts their words; the words of a kind
    have the same links, so links between two kinds are peeled together. A link that goes
    looks for the kinds that are linked to both its ends and lowers the support of those
    links alone; ``turn`` numbers the links that went, so of the links of a triangle that
    go at once the first one counts."""
    n = len(graph)
    inside = np.diag(graph).astype(np.float32)
    paths = _paths(graph.astype(np.float32), np.arange(n), sizes.astype(np.float32))
    # A word is no third to its own link.
    support = (paths - inside[:, None] - inside[None, :]).astype(np.int32).ravel()
    turn = np.where(graph, _STAYS, 0).astype(np.int32)
    level = np.ones(n, np.int64)
    left = np.flatnonzero(np.triu(graph))
    k, gone = 2, 0
    while len(left):
        now = support[left]
        k = max(k, int(now.min()) + 2)
        weak = left[now <= k - 2]
        while len(weak):
            u, v = np.divmod(weak, n)
            level[u] = level[v] = k
            order = np.arange(gone + 1, gone + 1 + len(weak), dtype=np.int32)
            gone += len(weak)
            turn[u, v] = turn[v, u] = order
            weaker = []
            step = max(1, CELLS_AT_ONCE // n)
            for start in range(0, len(weak), step):
                a, b, at = (x[start:start + step] for x in (u, v, order))
                third = (turn[a] > at[:, None]) & (turn[b] > at[:, None])
                row = np.arange(len(a))
                third[row, a], third[row, b] = turn[a, a] > at, turn[b, b] > at
                e, w = np.nonzero(third)
                x, y = a[e], b[e]
                same = x == y
                keys = np.concatenate([np.minimum(x, w) * n + np.maximum(x, w),
                                       (np.minimum(y, w) * n + np.maximum(y, w))[~same]])
                lost = np.concatenate([sizes[y] - same, sizes[x][~same]]).astype(np.int32)
                np.subtract.at(support, keys, lost)
                # Support only falls, so the last step that takes of a link finds it weak.
                weaker.append(np.unique(keys[(turn.ravel()[keys] == _STAYS) & (support[keys] <= k - 2)]))
            weak = np.unique(np.concatenate(weaker))
        left = left[turn.ravel()[left] == _STAYS]
    return level


def _kinds(sentence: np.ndarray, node: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(kind of each node, kinds in each window, words of each kind). A window is two
    neighbouring sentences; words of one kind stand in the same windows."""
    last = max(int(sentence.max()), 1)
    present = np.stack([sentence, node], axis=1)
    windows = np.unique(np.concatenate([present, present - [1, 0]]), axis=0)
    windows = windows[(windows[:, 0] >= 0) & (windows[:, 0] < last)]
    order = np.lexsort((windows[:, 0], windows[:, 1]))
    owner, window = windows[order, 1], windows[order, 0]
    ends = np.flatnonzero(np.append(np.diff(owner), 1)) + 1
    seen: dict[bytes, int] = {}
    kind = np.zeros(n, np.int64)
    for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
        kind[owner[start]] = seen.setdefault(window[start:end].tobytes(), len(seen))
    held = [np.frombuffer(key, window.dtype) for key in seen]
    flat = np.concatenate(held)
    of = np.repeat(np.arange(len(held)), [len(h) for h in held])
    order = np.argsort(flat, kind="stable")
    members = np.split(of[order], np.flatnonzero(np.diff(flat[order])) + 1)
    return kind, members, np.bincount(kind, minlength=len(held))


def _connectivity(sentence: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """Semantic strength times connectivity of the candidates of one document.

    Words of a window are linked, by as many windows as they share. Words that occur in
    the same windows are one kind: the table of links is as wide as there are kinds, of
    which a stretch of text without repeated words has one a sentence.
    """
    kind, members, sizes = _kinds(sentence, node, n)
    graph = np.zeros((len(sizes), len(sizes)), bool)
    for m in members:
        graph[np.ix_(m, m)] = True
    graph[np.diag_indices(len(sizes))] = sizes > 1
    level = _truss(graph, sizes)
    strength = np.zeros(len(sizes))
    for m in members:
        strength[m] += (sizes[m] * level[m]).sum() - level[m]
    of, to = np.nonzero(graph)
    width = int(level.max()) + 1
    kinds = np.bincount(np.unique(of * width + level[to]) // width, minlength=len(sizes))
    return (strength * kinds / level.max())[kind]


def _stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` numbers each, from ``starts`` on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order; ``np.unique`` of numbers without its hashing, which takes longer."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _marks(window: np.ndarray) -> np.ndarray:
    """A number of 64 bits that looks random for each window."""
    x = window.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _same_windows(owner: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of each node, a node of each kind), from the windows of each node in order.
    Nodes with equal sums of marks are compared window by window, so the marks only steer."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    counts = np.diff(np.append(starts, len(owner)))
    _, heads, kind = np.unique(np.add.reduceat(_marks(window), starts), return_index=True, return_inverse=True)
    twin = heads[kind]
    place = np.minimum(np.arange(len(owner)) + (starts[twin] - starts)[owner], len(owner) - 1)
    other = (counts != counts[twin]) | (np.bincount(owner, window[place] != window) > 0)
    kind[other] = len(heads) + np.arange(other.sum())
    return kind, np.concatenate([heads, np.flatnonzero(other)])


def _triangles(u: np.ndarray, v: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(links, loss): the three links of each triangle, and how much support each of them has
    from it. ``u`` < ``v`` are kinds, in order; kinds are numbered by document. A kind of
    several words is linked to itself, behind the other links, and makes a triangle with each
    link of its own; the third link is none, one behind the last."""
    n, links = len(sizes), len(u)
    base = np.searchsorted(doc, doc)
    width = np.bincount(doc, minlength=doc[-1] + 1)
    corner = np.concatenate([[0], np.cumsum(width * width)])
    dense = corner[-1] <= MOST_CELLS
    if dense:
        row = corner[doc] - base
        table = np.full(corner[-1], -1, np.int32)
        table[row[u] + (u - base[u]) * width[doc[u]] + v] = np.arange(links)
        row += (np.arange(n) - base) * width[doc]
    else:
        keys = u * n + v
    after = np.cumsum(np.bincount(u, minlength=n))[u] - 1 - np.arange(links)
    first, second = np.repeat(np.arange(links), after), _stretches(np.arange(1, links + 1), after)
    if dense:
        third = table[row[v[first]] + v[second]]
        found = np.flatnonzero(third >= 0)
        third = third[found]
    else:
        wanted = v[first] * n + v[second]
        third = np.minimum(np.searchsorted(keys, wanted), max(links - 1, 0))
        found = np.flatnonzero(keys[third] == wanted) if links else third
        third = third[found]
    first, second = first[found].astype(np.int32), second[found].astype(np.int32)
    own = np.full(n, -1)
    many = np.flatnonzero(sizes > 1)
    own[many] = links + np.arange(len(many))
    left, right = np.flatnonzero(own[u] >= 0), np.flatnonzero(own[v] >= 0)
    none = np.full(len(left) + len(right), links + len(many))
    parts = [
        [first, left, right],
        [second, own[u[left]], own[v[right]]],
        [third, none],
    ]
    loss = [
        [sizes[v[second]], sizes[u[left]] - 1, sizes[v[right]] - 1],
        [sizes[v[first]], sizes[v[left]], sizes[u[right]]],
        [sizes[u[first]], none * 0],
    ]
    return [np.concatenate(p).astype(np.int32) for p in parts], [np.concatenate(p).astype(np.int32) for p in loss]


def _levels(u: np.ndarray, v: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``_truss`` of many documents at once, by their triangles: a triangle goes with the
    first of its links and lowers the support of the others."""
    links, loss = _triangles(u, v, sizes, doc)
    many = np.flatnonzero(sizes > 1)
    one, two = np.concatenate([u, many]), np.concatenate([v, many])
    n, count = len(one), len(links[0])
    support = np.zeros(n + 1)
    for link, lost in zip(links, loss):
        support += np.bincount(link, lost, minlength=n + 1)
    support[len(u):n] += sizes[many] - 2
    support = support.astype(np.int32)
    # The triangles of each link: pairs of link and triangle, sorted as one number.
    held = np.concatenate(links).astype(np.int64)
    held_by = np.cumsum(np.concatenate([[0], np.bincount(held, minlength=n + 1)]))
    held <<= 32
    held |= np.tile(np.arange(count), 3)
    held.sort()
    triangle = held.astype(np.int32)
    del held
    there, seen = np.ones(count, bool), np.zeros(count, np.int32)
    gone = np.zeros(n + 1, bool)
    gone[n] = True
    level = np.ones(len(sizes), np.int64)
    left, k = np.arange(n), 2
    while len(left):
        now = support[left]
        k = max(k, int(now.min()) + 2)
        weak = left[now <= k - 2]
        while len(weak):
            level[one[weak]] = level[two[weak]] = k
            gone[weak] = True
            starts = held_by[weak]
            t = triangle[_stretches(starts, held_by[weak + 1] - starts)]
            t = t[there[t]].astype(np.int64)
            place = np.arange(len(t), dtype=np.int32)
            seen[t] = place
            t = t[seen[t] == place]
            there[t] = False
            keys = np.concatenate([link[t] for link in links])
            stay = np.flatnonzero(~gone[keys])
            keys = keys[stay].astype(np.int64)
            np.subtract.at(support, keys, np.concatenate([lost[t] for lost in loss])[stay])
            weak = _distinct(keys[support[keys] <= k - 2])
        left = left[~gone[left]]
    return level


def _groups(weight: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of neighbours that weigh about ``most`` together."""
    starts = np.flatnonzero(np.diff(np.cumsum(weight) // most, prepend=-1))
    return list(zip(starts, np.append(starts[1:], len(weight))))


def _connectivities(stream: _Stream) -> np.ndarray:
    """``_connectivity`` of the nodes of all documents of a batch."""
    out = np.zeros(stream.n)
    if not stream.n:
        return out
    doc, sentence, node = np.cumsum(np.diff(stream.doc, prepend=-1) > 0) - 1, stream.sentence.astype(np.int64), stream.node
    tokens = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    last = np.maximum(np.maximum.reduceat(sentence, tokens[:-1]), 1)
    number = (np.cumsum(last) - last)[doc] + sentence
    total = int(last.sum())
    here, before = sentence < last[doc], sentence > 0
    owner, window = np.divmod(
        _distinct(np.concatenate([node[here] * total + number[here], node[before] * total + number[before] - 1])), total)
    kind, heads = _same_windows(owner, window)
    is_head = np.zeros(stream.n, bool)
    is_head[heads] = True
    member, at = kind[owner[is_head[owner]]], window[is_head[owner]]
    held = np.bincount(at, minlength=total)
    pairs = np.bincount(np.repeat(np.arange(len(last)), last), held * (held - 1) // 2)
    # Documents from few to many pairs, so that those of a group take about as many rounds.
    rank = np.empty(len(last), np.int64)
    rank[np.argsort(pairs, kind="stable")] = np.arange(len(last))
    pairs = np.sort(pairs, kind="stable")
    node_doc = np.zeros(stream.n, np.int64)
    node_doc[node] = rank[doc]
    order = np.argsort(node_doc[heads], kind="stable")
    renumbered = np.empty(len(order), np.int64)
    renumbered[order] = np.arange(len(order))
    kind, member = renumbered[kind], renumbered[member]
    of, sizes = node_doc[heads][order], np.bincount(kind)
    bounds = np.searchsorted(of, np.arange(len(last) + 1))
    alone = list(np.flatnonzero(pairs > MOST_PAIRS))
    order = np.lexsort((at, member))
    member, at = member[order], at[order]
    scores = np.zeros(len(sizes))
    for d, e in _groups(pairs, PAIRS_AT_ONCE):
        e = min(e, len(last) - len(alone))
        if d < e:
            rows = slice(*np.searchsorted(member, [bounds[d], bounds[e]]))
            kinds = slice(bounds[d], bounds[e])
            heavy = _group_scores(member[rows] - bounds[d], at[rows], sizes[kinds], of[kinds] - d, scores[kinds])
            alone += [d + h for h in heavy]
    out[:] = scores[kind]
    back = np.argsort(rank)
    for d in back[alone] if len(alone) else []:
        mine = slice(tokens[d], tokens[d + 1])
        nodes, local = np.unique(node[mine], return_inverse=True)
        out[nodes] = _connectivity(sentence[mine], local, len(nodes))
    return out


def _group_scores(member: np.ndarray, at: np.ndarray, sizes: np.ndarray, doc: np.ndarray, out: np.ndarray) -> list[int]:
    """Writes the scores of the kinds of some documents, given the windows that hold them;
    returns the documents with too many wedges, which are left out."""
    order = np.lexsort((member, at))
    member, at = member[order], np.cumsum(np.diff(at[order], prepend=-1) > 0) - 1
    n = len(sizes)
    after = np.cumsum(np.bincount(at))[at] - 1 - np.arange(len(at))
    pairs = np.repeat(member * n, after) + member[_stretches(np.arange(1, len(at) + 1), after)]
    a, b = np.divmod(_distinct(pairs), n)
    # Kinds with few links first, which makes few wedges.
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    place = np.empty(n, np.int64)
    order = np.lexsort((degree, doc))
    place[order] = np.arange(n)
    u, v = np.divmod(np.sort(np.minimum(place[a], place[b]) * n + np.maximum(place[a], place[b])), n)
    sizes, member = sizes[order], place[member]
    rest = np.bincount(u, minlength=n)
    wedges = np.bincount(doc, rest * (rest - 1) // 2).astype(np.int64)
    width = np.bincount(doc)
    heavy = wedges > MOST_WEDGES
    level = np.ones(n, np.int64)
    for d, e in _groups(np.where(heavy, WEDGES_AT_ONCE, wedges + np.minimum(width * width, WEDGES_AT_ONCE)), WEDGES_AT_ONCE):
        kept = np.flatnonzero(~heavy[d:e]) + d
        if not len(kept):
            continue
        low, high = np.searchsorted(doc, [d, e])
        some = np.flatnonzero(~heavy[doc[low:high]]) + low
        local = np.full(high - low, -1)
        local[some - low] = np.arange(len(some))
        x, y = np.searchsorted(u, [low, high])
        use = np.flatnonzero(~heavy[doc[u[x:y]]]) + x
        level[some] = _levels(local[u[use] - low], local[v[use] - low], sizes[some], doc[some] - d)
    strength = np.bincount(member, np.bincount(at, sizes[member] * level[member])[at] - level[member], minlength=n)
    many = np.flatnonzero(sizes > 1)
    high = int(level.max()) + 1
    seen = _distinct(np.concatenate([u * high + level[v], v * high + level[u], many * high + level[many]])) // high
    kinds = np.bincount(seen, minlength=n)
    top = np.maximum.reduceat(level, np.searchsorted(doc, np.arange(len(width))))
    out[order] = strength * kinds / top[doc]
    return list(np.flatnonzero(heavy))


def scake(stream: _Stream) -> np.ndarray:
    """sCAKE word scores: strength times connectivity in the graph of words shared
    by two neighbouring sentences, times the positional weight."""
    within = stream.place - stream.offsets[stream.doc] + 1
    position = np.bincount(stream.node, 1.0 / within, minlength=stream.n)
    return (_connectivities(stream) * position)[stream.node]
