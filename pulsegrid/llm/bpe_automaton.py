"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens: its arcs carry token ids, and a sequence of ids is a
path exactly if it is how BPE cuts the bytes it spells. It begins as one state
with a loop per byte. Each merge ``u v`` of the list, in order, is worked in by a
gadget: the arcs of ``u`` are led to a copy of their target that lacks the arc of
``v`` (``u`` followed by ``v`` is no longer how a text is cut), and wherever ``u``
and then ``v`` could be read, one arc of the joint token leads to where ``v`` led.

All arcs of a token lead to one state, so a state is a token and the gadgets its
arcs have been through. A copy shares all but one arc with its original; it is
kept as that one removed arc and the step it was removed at, and whether a state
has an arc is looked up in these tables. Each word has exactly one path. It is
found by taking the longest arc that a state has, for many words at once; where
that leads to a place from which a word cannot be ended, shorter arcs are tried.
Decoding writes out the bytes that the arcs spell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import BASE, INVERSE, mix, ranges, slices, text_buffer

# Fixed value: the pattern by which the public vocabulary cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
# A worker forgets the pieces of text it has met beyond so many.
MAX_PIECES = 1_000_000
WHITE = " \t\n\v\f\r"
WINDOW_BYTES = 1 << 19


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100."""
    out, beyond = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(beyond)
            beyond += 1
    return out


class Automaton:
    """The compiled merges of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], {c: b for b, c in byte_letters().items()}
        split = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        if any(regex.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with white space")
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.labels = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.labels[i] = content.encode()
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(regex.escape(c) for c in by_length)) if by_length else None
        self.pattern = regex.compile(WORDS)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._compile([vocab[byte_letters()[b]] for b in range(256)], [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs])
        ends = np.cumsum([0, *map(len, self.labels)])
        self.label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)
        self.label_start, self.label_size = ends[:-1], np.diff(ends)

    def _compile(self, singles: list[int], merges: list[tuple[int, int, int]]) -> None:
        # what stands first and last in a joint token, and the step of the gadget that made its arcs
        self.first, self.last, self.born = {}, {}, {}
        # per token the arcs that its gadgets took from the states behind it, with their steps
        self.removed: dict[int, dict[int, int]] = {}
        made = set(singles)
        for step, (u, v, joint) in enumerate(merges):
            if joint in made:
                raise ValueError("two merges make the same token")
            if u not in made or v not in made or not self._arc(u, v):
                continue  # u is never followed by v, so the merge never happens
            self.removed.setdefault(u, {})[v] = step
            self.first[joint], self.last[joint], self.born[joint] = u, v, step
            made.add(joint)
        # spellings as a tree of bytes: node and byte give a node; a node may end a token
        self.step_of, self.token_at, nodes = {}, {}, 1
        tokens = {self.labels[t]: t for t in made}
        self.longest = max(map(len, tokens))
        # the longest token that a token begins with, itself apart
        self.shorter = np.full(len(self.labels), -1, np.int64)
        for label, t in tokens.items():
            begins = (tokens.get(label[:k]) for k in range(len(label) - 1, 0, -1))
            self.shorter[t] = next((x for x in begins if x is not None), -1)
        for t in made:
            node = 0
            for b in self.labels[t]:
                key = node << 8 | b
                node = self.step_of.get(key)
                if node is None:
                    node = self.step_of[key] = nodes
                    nodes += 1
            self.token_at[node] = t
        self._tabulate(made)

    def _tabulate(self, made: set[int]) -> None:
        """The same tables as sorted arrays, for many look-ups at once."""
        keys = np.fromiter(self.step_of, np.int64, len(self.step_of))
        order = keys.argsort()
        self.step_keys = keys[order]
        self.step_nodes = np.fromiter(self.step_of.values(), np.int64, len(keys))[order]
        self.node_tokens = np.full(len(keys) + 1, -1, np.int64)
        self.node_tokens[np.fromiter(self.token_at, np.int64)] = np.fromiter(self.token_at.values(), np.int64)
        gone = np.array([(u, v, at) for u, arcs in self.removed.items() for v, at in arcs.items()], np.int64).reshape(-1, 3)
        keys = gone[:, 0] << 32 | gone[:, 1]
        order = keys.argsort()
        self.gone_keys, self.gone_steps = np.append(keys[order], np.iinfo(np.int64).max), np.append(gone[order, 2], 0)
        never = np.iinfo(np.int64).max

        def chains(part: dict[int, int]) -> tuple[np.ndarray, ...]:
            """Of each token the parts at one end of it, and the step that joined each to more."""
            parts, steps, begins = [], [], np.zeros(len(self.labels) + 1, np.int64)
            for t in range(len(self.labels)):
                x, until = (t, never) if t in made else (None, never)
                while x is not None:
                    parts.append(x)
                    steps.append(until)
                    until, x = self.born.get(x, never), part.get(x)
                begins[t + 1] = len(parts)
            return np.array(parts, np.int64), np.array(steps, np.int64), begins

        self.last_chain, self.first_chain = chains(self.last), chains(self.first)

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_arc`` for many pairs."""
        (last, until, a), (first, drawn, b) = self.last_chain, self.first_chain
        wide = b[y + 1] - b[y]
        n = (a[x + 1] - a[x]) * wide
        row = np.repeat(np.arange(len(x)), n)
        k = ranges(np.zeros(len(n), np.int64), n)
        i, j = a[x[row]] + k // wide[row], b[y[row]] + k % wide[row]
        key = last[i] << 32 | first[j]
        at = np.searchsorted(self.gone_keys, key)
        step = self.gone_steps[at]
        missing = (self.gone_keys[at] == key) & (step < until[i]) & (step <= drawn[j])
        return np.bincount(row[missing], minlength=len(x)) == 0

    def _arc(self, x: int, y: int) -> bool:
        """Whether the state behind ``x`` has an arc of ``y``.

        The state of a joint token is the one its last part led to when the token
        came up, so arcs removed there earlier are missing as well; and a joint
        token's arc was only drawn where its first part still had one.
        """
        until = None
        while True:
            gone = self.removed.get(x)
            if gone:
                part, drawn = y, None
                while True:
                    at = gone.get(part)
                    if at is not None and (until is None or at < until) and (drawn is None or at <= drawn):
                        return False
                    drawn = self.born.get(part)
                    if drawn is None:
                        break
                    part = self.first[part]
            until = self.born.get(x)
            if until is None:
                return True
            x = self.last[x]

    def _longest(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that stands at each place; ``ends`` is where the word of the place ends."""
        out, node, at = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64), np.arange(len(data))
        for depth in range(self.longest):
            at = at[at + depth < ends[at]]
            key = node[at] << 8 | data[at + depth]
            to = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            same = self.step_keys[to] == key
            at = at[same]
            if not len(at):
                break
            node[at] = self.step_nodes[to[same]]
            token = self.node_tokens[node[at]]
            out[at[token >= 0]] = token[token >= 0]
        return out

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has.

        All words move at once: each takes its longest arc, tries the next shorter
        one where that is missing, and goes back a token where none is left. As a
        prefix has only one path, a place that was left so is not entered again.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(size) - size
        longest = self._longest(data, np.repeat(base + size, size))
        path, dead = np.empty(len(data), np.int64), np.zeros(len(data) + 1, bool)
        done, depth = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        on = np.flatnonzero(size)
        token = np.full(len(words), -1, np.int64)
        token[on] = longest[base[on]]
        while len(on):
            none = token[on] < 0
            back, ahead = on[none], on[~none]
            dead[base[back] + done[back]] = True
            depth[back] -= 1
            top = path[base[back] + depth[back]]
            done[back] -= self.label_size[top]
            token[back] = self.shorter[top]
            y = token[ahead]
            to = done[ahead] + self.label_size[y]
            ok = (to == size[ahead]) | ~dead[base[ahead] + to]
            asked = np.flatnonzero(ok & (depth[ahead] > 0))
            ok[asked] = self.arcs(path[base[ahead[asked]] + depth[ahead[asked]] - 1], y[asked])
            token[ahead[~ok]] = self.shorter[y[~ok]]
            step, to = ahead[ok], to[ok]
            path[base[step] + depth[step]] = y[ok]
            depth[step] += 1
            done[step] = to
            further = to < size[step]
            token[step[further]] = longest[base[step[further]] + to[further]]
            on = on[done[on] < size[on]]
        return path[ranges(base, depth)].astype(np.int32), depth

    def words_of(self, text: str) -> list[str]:
        """The words of a text, added tokens among them."""
        if not self.added_pattern:
            return self.pattern.findall(text)
        out: list[str] = []
        at = 0
        for found in self.added_pattern.finditer(text):
            out += self.pattern.findall(text, at, found.start())
            out.append(found.group())
            at = found.end()
        out += self.pattern.findall(text, at) if at else self.pattern.findall(text)
        return out


@cache
def automaton(path: str) -> Automaton:
    """The automaton of this worker for a vocabulary file."""
    return Automaton(path)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their words: before ASCII white space behind any other character.

    No word goes on there, and none looks back. Characters beyond ASCII count as
    others if their first byte is one that no white space has.
    """
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    b1, b2, b3, b4 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
    tail2, tail3 = (b2 >= 0x80) & (b2 < 0xC0), (b3 >= 0x80) & (b3 < 0xC0)
    # control characters that some take for white space are left uncut
    plain = (b1 < 0x80) & (b1 > 0x1F)
    two = (b1 >= 0x80) & (b2 >= 0xC3) & (b2 < 0xE0)
    three = (b1 >= 0x80) & tail2 & (b3 >= 0xE4) & (b3 < 0xF0)
    four = (b1 >= 0x80) & tail2 & tail3 & (b4 >= 0xF0)
    full = offsets[:-1][np.diff(offsets) > 0]
    return np.union1d(at[plain | two | three | four], full)


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes and length of each piece; pieces lie one after another."""
    out = np.empty(len(starts), np.uint64)
    edges = np.append(starts, len(data))
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(edges, edges[first] + WINDOW_BYTES, side="right")) - 1, first + 1)
        a, b = int(edges[first]), int(edges[last])
        power, inverse = _powers(max(19, int(b - a).bit_length()))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_byte_values()[data[a:b]] * power[: b - a], dtype=np.uint64)))
        at = edges[first : last + 1] - a
        size = np.diff(at).astype(np.uint64)
        out[first:last] = mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]] + mix(size))
        first = last
    return out


class Encoder:
    """Encodes columns of text by an automaton and keeps the ids of the pieces of text it has met."""

    def __init__(self, path: str):
        self.automaton = automaton(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.begins, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def _pieces(self, texts: list[str], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and how many each has.

        Pieces that begin with white space and end with something else (``joined``)
        are cut into words together: no word goes from one to the next.
        """
        tables = self.automaton
        together = [t for t, j in zip(texts, joined) if j]
        words = tables.words_of("".join(together))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        edges = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
        held = np.diff(np.searchsorted(ends, edges, side="right"), prepend=0)
        counts = np.zeros(len(texts), np.int64)
        counts[joined] = held
        order = [np.repeat(np.flatnonzero(joined), held)]
        for i in np.flatnonzero(~joined).tolist():
            own = tables.words_of(texts[i])
            words += own
            counts[i] = len(own)
            order.append(np.full(len(own), i))
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        distinct = list(number)
        special = [k for k, w in enumerate(distinct) if w in tables.added] if tables.added else []
        ids, sizes = tables.many([w.encode("utf-8") for w in distinct])
        begins = np.cumsum(sizes) - sizes
        if special:
            begins[special], sizes[special] = len(ids) + np.arange(len(special)), 1
            ids = np.concatenate((ids, np.array([tables.added[distinct[k]] for k in special], np.int32)))
        which = which[np.concatenate(order).argsort(kind="stable")]
        flat = ids[ranges(begins[which], sizes[which])]
        of = np.repeat(np.arange(len(texts)), counts)
        return flat, np.bincount(of, sizes[which], minlength=len(texts)).astype(np.int64)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and, for each row, where its ids begin (one place more at the end)."""
        if len(self.place) > MAX_PIECES:
            self.clear()
        data, offsets = text_buffer(col)
        starts = piece_starts(data, offsets)
        hashes, first, of = np.unique(piece_hashes(data, starts), return_index=True, return_inverse=True)
        stops = np.append(starts[1:], len(data))
        place, named = self.place, hashes.tolist()
        new = first[[h not in place for h in named]] if len(named) else first
        if len(new):
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), stops[new].tolist())]
            joined = np.fromiter((t[0] in WHITE and t[-1] > " " and not t[-1].isspace() for t in texts), bool, len(texts))
            ids, sizes = self._pieces(texts, joined)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
            self.pool[self.used : self.used + len(ids)] = ids
            self.begins = np.concatenate((self.begins, self.used + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.used += len(ids)
            for h in named:
                if h not in place:
                    place[h] = len(place)
        entry = np.fromiter(map(place.__getitem__, named), np.int64, len(named))[of]
        sizes = self.sizes[entry]
        ids = self.pool[ranges(self.begins[entry], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return ids, ends[np.searchsorted(starts, offsets)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def spelled(tables: Automaton, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts that rows of ids spell; broken UTF-8 becomes U+FFFD, an id that is none spells nothing."""
    known = (ids >= 0) & (ids < len(tables.label_size))
    safe = np.where(known, ids, 0)
    sizes = np.where(known, tables.label_size[safe], 0)
    data = tables.label_bytes[ranges(tables.label_start[safe], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[bounds]
    raw = data.tobytes()
    inner = ends[ends < len(data)]
    try:
        raw.decode("utf-8")
        whole = not ((data[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.string())
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())


def encode(docs: DataFrame, *, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` without the text, with the ids of each whole text as an array of int.

    ``decoded`` names a further column with the text that those very ids spell.
    A null text is encoded as the empty one, an empty text has no ids. Equal rows
    are encoded each, in any order; a very long text is one row of one batch, and
    its memory grows with its own length only. Added tokens that stand in a text
    (``<|endoftext|>``) become their ids, as in the library. Columns of the input
    with the names of the new ones are replaced. An empty table gives an empty one.
    """
    new = [ids] + ([decoded] if decoded else [])
    kept = [c for c in docs.columns if c != text and c not in new]
    fields = [docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType(fields + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in slices(batches, "__text"):
            flat, bounds = coder.encode(batch.column(0))
            out = [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))]
            if decoded:
                out.append(spelled(coder.automaton, flat, bounds))
            yield pa.record_batch(out, names=schema.names)

    return _numbered(docs, F.col(f"`{text}`").cast("string").alias("__text"), kept).mapInArrow(run, schema)


def _numbered(df: DataFrame, first: Column, kept: list[str]) -> DataFrame:
    """The first column and the kept ones under names of their places, so that it does not matter what they are called."""
    return df.select(first, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])


def decode(rows: DataFrame, *, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` without the ids, with the text they spell; added tokens are spelled too.

    Null ids give a null text, no ids the empty one. Ids that the vocabulary does
    not have spell nothing, bytes that are no UTF-8 become U+FFFD, both as in the
    library. A column named like the new one is replaced.
    """
    kept = [c for c in rows.columns if c not in (ids, text)]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = automaton(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(0)
                full = col.fill_null([]) if col.null_count else col
                flat = full.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate(([0], np.cumsum(full.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
                texts = spelled(tables, flat, bounds)
                if col.null_count:
                    texts = pa.compute.if_else(col.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.record_batch([*part.columns[1:], texts], names=schema.names)

    source = F.col(f"`{ids}`").cast("array<bigint>").alias("__ids")
    return _numbered(rows, source, kept).mapInArrow(run, schema)
