"""BPE encoding and decoding by a compiled deterministic automaton over tokens.

Compilation starts with one state that loops on every byte and adds a merge gadget for each merge (u, v) in order of rank.
All arcs of a token lead to one state. The gadget splits the state q that u's arcs reach: they now reach a copy of q without
its v-arc (after u, a v would have been merged), and each state with a u-arc gets an arc for uv to where v led from q. So a
state is the trail of arcs removed on the way to it, with the rank of the merge that removed them, and it has an arc for a
token unless a token on its left spine was removed before it grew into the next one. States that nothing reaches go, and the
arcs that the others lack are compiled into one bit table, state by token.

A pre-split word's encoding is the only path that the automaton accepts. Words are encoded many at a time: a trie of the
labels gives the arcs that fit at each byte, the bit table says which of them their state has, from left to right.
Decoding emits the labels (byte strings) of the arcs.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import table

VOCABULARY = "byte_bpe_50k.json"
#: Words that a task remembers, at about 250 bytes each; when full, it starts anew. Nothing is kept between tasks.
CACHE = 100_000
#: Characters that are split at a time; longer texts are cut where white space follows something else, as words end there.
PIECE = 1_000_000
CUT = re.compile(r"(?<=\S)(?=\s)")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.pattern = regex.compile(pattern)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        label = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in self.special.items()}
        size = max(label) + 1
        merges = [tuple(ids[raw(x)] for x in (m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        made = [ids[label[u] + label[v]] for u, v in merges]
        reached, spine = self._gadgets([ids[bytes([b])] for b in range(256)], merges, made)
        self._compile(reached, spine, size)
        self._trie(ids)
        # labels end to end: no object stays that would keep the memory of compiling in use
        self.labels = np.frombuffer(b"".join(label.get(k, b"") for k in range(size)), np.uint8)
        self.length = np.array([len(label.get(k, b"")) for k in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _gadgets(self, single: list[int], merges: list[tuple[int, int]], made: list[int]) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
        """The state that each token's arcs reach, and each token's left spine with the rank at which each part of it grew."""
        reached, spine = dict.fromkeys(single, 0), {t: [] for t in single}
        self.before, self.gone = [0], [(-1, -1)]  # of a state: the one it was split from, and (token, rank) of the arc it lacks
        for rank, ((u, v), w) in enumerate(zip(merges, made, strict=True)):
            q, to = reached[u], reached[v]
            self.before.append(q)
            self.gone.append((v, rank))
            reached[u] = len(self.gone) - 1
            reached[w] = to
            spine[w] = [*spine[u], (u, rank)]
        return reached, spine

    def _compile(self, reached: dict[int, int], spine: dict[int, list[tuple[int, int]]], width: int) -> None:
        """``state``: of each token the number of the state it leads to. ``lacks``: a bit for each state and ``column`` of a token."""
        never = len(self.gone) + 1
        over: dict[int, list[tuple[int, int]]] = {}  # of each token: tokens that have it on their left spine, and when it grew there
        for token, parts in spine.items():
            for part, grown in [*parts, (token, never)]:
                over.setdefault(part, []).append((grown, token))
        grown = {k: np.array(sorted(v, reverse=True), np.int64) for k, v in over.items()}
        live = sorted(set(reached.values()))
        number = {q: k for k, q in enumerate(live)}
        self.state = np.zeros(width, np.int32)
        for token, q in reached.items():
            self.state[token] = number[q]
        rng = np.random.Generator(np.random.PCG64(5))
        rows, mark = [], np.zeros(width, np.uint64)
        for q in live:
            row = np.zeros(width, np.uint8)
            while q:
                token, rank = self.gone[q]
                since = grown[token]
                row[since[: np.searchsorted(-since[:, 0], -rank, "right"), 1]] = 1
                q = self.before[q]
            mark ^= row * rng.integers(0, 2**63, dtype=np.uint64)
            rows.append(np.flatnonzero(row).astype(np.int32))
        # tokens that the same states lack share a column
        _, first, column = np.unique(mark, return_index=True, return_inverse=True)
        self.column = column.astype(np.int32)
        self.lacks = np.zeros((len(live), (len(first) + 7) // 8), np.uint8)
        for k, row in enumerate(rows):
            bits = np.zeros(len(first), np.uint8)
            bits[column[row]] = 1
            packed = np.packbits(bits, bitorder="little")
            self.lacks[k, : len(packed)] = packed
        del self.before, self.gone

    def _trie(self, ids: dict[bytes, int]) -> None:
        """``edge``: sorted node * 256 + byte; ``child``: the node each leads to; ``token``: the token that ends there, or -1."""
        nodes, edges, ends = {b"": 0}, [], [-1]
        for label in sorted(ids):
            for n in range(1, len(label) + 1):
                if label[:n] not in nodes:
                    edges.append((nodes[label[: n - 1]] * 256 + label[n - 1], len(ends)))
                    nodes[label[:n]] = len(ends)
                    ends.append(-1)
            ends[nodes[label]] = ids[label]
        edges.sort()
        self.edge, self.child = (np.array(x, np.int32) for x in zip(*edges, strict=True))
        self.token = np.array(ends, np.int32)

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The accepted paths of words, end to end, and their bounds."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        begin = np.repeat(end - size, size)
        stop = np.repeat(end, size)
        at, node, found = np.arange(len(data)), np.zeros(len(data), np.int32), []
        step = 0
        while len(at):
            key = node * 256 + data[at + step]
            to = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[to] == key
            at, node = at[hit], self.child[to[hit]]
            step += 1
            ends = self.token[node]
            arc = np.flatnonzero(ends >= 0)
            found.append((at[arc], np.full(len(arc), step, np.int32), ends[arc]))
            more = at + step < stop[at]
            at, node = at[more], node[more]
        start, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        place = start - begin[start]
        order = np.argsort(place, kind="stable")
        start, token, finish = start[order], token[order], (start + length)[order]
        cut = np.searchsorted(place[order], np.arange(int(size.max(initial=0)) + 1)).tolist()
        # by the byte at which it ends: the only arc there that is on an accepted path; position 0 of a word is its start
        last, back = np.full(len(data) + 1, -1, np.int32), np.zeros(len(data) + 1, np.int64)
        for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            s, t, f = start[x:y], token[x:y], finish[x:y]
            if k:
                on = np.flatnonzero(last[s - 1] >= 0)
                s, t, f = s[on], t[on], f[on]
                at = self.column[t]
                ok = (self.lacks[self.state[last[s - 1]], at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
                s, t, f = s[ok], t[ok], f[ok]
            last[f - 1], back[f - 1] = t, s
        on = np.zeros(len(data), bool)
        at = end - 1
        while len(at):
            on[at] = True
            at = back[at] - 1
            at = at[at >= begin[at + 1]]
        marks = np.concatenate(([0], np.cumsum(on)))
        return last[:-1][on], np.concatenate(([0], marks[end]))

    def learn(self, pieces: set[str]) -> None:
        """Remember the paths of words."""
        if len(self.words) + len(pieces) > CACHE:
            self.words.clear()
        new = [p for p in pieces if p not in self.words]
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            tokens, bounds = self.paths([p.encode() for p in some])
            flat, cut = tokens.astype("<u4").tobytes(), (bounds * 4).tolist()
            self.words.update((p, flat[x:y]) for p, x, y in zip(some, cut[:-1], cut[1:], strict=True))

    def parts(self, text: str) -> Iterator[str]:
        """The text in runs of about PIECE characters that can be split on their own."""
        at = 0
        while len(text) - at > PIECE:
            m = CUT.search(text, at + PIECE)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, seen = [], set()
        for text in texts:
            some = self.split.split(text) if self.split is not None and any(s in text for s in self.special) else (text,)
            split.append([(s, None) if s in self.special else (s, self.pattern.findall(s)) for s in some])
            for _, pieces in split[-1]:
                seen.update(pieces or ())
        self.learn(seen)
        words = self.words
        return [b"".join([self.special[s].to_bytes(4, "little") if pieces is None else b"".join([words[p] for p in pieces]) for s, pieces in one]) for one in split]

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_all([part])[0] for part in self.parts(text))

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, end to end; bytes that are not UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4")
        n = self.length[tokens]
        at = np.repeat(self.start[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.labels[at].tobytes().decode("utf-8", "replace")


def _give_back() -> None:
    """Memory that is free goes back to the machine, where the C library can do that; workers live longer than tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, compiled once in each worker process. Its place is a parameter everywhere."""
    import public_tokenizers

    made = Automaton(path, public_tokenizers.PATTERN)
    _give_back()
    return made


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _together(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of consecutive texts of about PIECE characters."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > PIECE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _coder(path: str, with_ids: bool):
    def run(batches):
        coder = automaton(path)
        for batch in batches:
            n, shas, texts, lists = [], [], [], []
            for some in _together(x.as_py() or "" for x in batch.column("text")):
                codes = [[c] for c in coder.encode_all(some)] if len(some) > 1 else [[coder.encode_all([part])[0] for part in coder.parts(some[0])]]
                for code in codes:
                    ids, back = hashlib.sha256(), hashlib.sha256()
                    for part in code:
                        ids.update(part)
                        back.update(coder.decode(part).encode())
                    n.append(sum(map(len, code)) // 4)
                    shas.append(ids.hexdigest())
                    texts.append(back.hexdigest())
                    if with_ids:
                        lists.append(np.frombuffer(b"".join(code), "<u4").astype(np.int32))
            columns = {"row": batch.column("row"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        coder.words.clear()
        _give_back()

    return run


def encode_decode(df: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Each row of ``df`` as ``row``, its text's token ids, their number, and digests of the ids and of the decoded text.

    A null text is the empty one: no tokens. Text is never cut. There is no shuffle; a row's memory is its own text.
    """
    names = [c for c in df.columns if c != "text"]
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text")
    kind = kept.schema["row"].dataType.simpleString()
    out = "row " + kind + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return kept.mapInArrow(_coder(path or vocabulary(), with_ids), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's id, number of tokens and digests."""
    out = encode_decode(docs.select("doc_id", "text"), with_ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
