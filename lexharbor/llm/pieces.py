"""Operator 8: SentencePiece encoding by vectorised merge rounds, and decoding.

The model file's pieces and scores are read with the library; the encoding is done here.  A text is cut into segments
that no merge can cross: before every space mark that follows another character, and around characters that are in no
longer piece.  The distinct segments of a chunk form one flat array of symbols.  In each round every segment finds its
smallest pair rank (best score), merges the leftmost non-overlapping pairs of that rank at once, and the array is
compacted, until no pair remains.  Where a merged piece can itself form a pair of the same or a better rank, only the
leftmost pair is merged in that round, as a queue by (score, position) would.

Runs of spaces only merge with each other after everything else; a run is encoded by the same rule, once per length.

Characters that are no piece become byte pieces.  Decoding is the library's decode(ids).

Defined cases.  Null text: empty; its only id is the end id, decoded to the empty text.  Texts that are only spaces,
very long words and very long texts go the same way.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import Chunk, U64, chunks, ragged, read_texts, released, schema, spans_hash, table, texts, tokenizer_file

MODEL = "piece_bpe_32k.model"
MARK = "▁"
IDS = schema("doc_id:long,n_tokens:long,ids_sha256:string,decoded_sha256:string")
#: Most distinct segments that a worker remembers between chunks.
MEMO = 1_000_000
_NONE = np.int32(1 << 30)


class PieceModel:
    """The model's tables: symbols are piece ids; symbols that are no piece have ids from n on."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = self.lib.get_piece_size()
        self.end = self.lib.eos_id()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.piece = {self.lib.id_to_piece(i): i for i in plain}
        self.bytes = np.array([self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # Ranks: equal for equal scores, smaller for better ones.
        scores = {i: self.lib.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {i: order[s] for i, s in scores.items()}
        left, right, made = [], [], []
        inside: set[str] = set()
        for p, i in self.piece.items():
            if len(p) > 1 and p.strip(MARK):
                for k in range(1, len(p)):
                    a, b = self.piece.get(p[:k]), self.piece.get(p[k:])
                    if a is not None and b is not None:
                        left.append(a), right.append(b), made.append(i)
                        inside |= set(p)
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        self.ranks = np.full(n + 1, _NONE, np.int32)
        self.ranks[list(self.rank)] = list(self.rank.values())
        # Merging this piece can open a pair that is no worse: then one merge at a time.
        best = np.full(n + 1, _NONE, np.int32)
        r = self.ranks[self.made]
        np.minimum.at(best, self.left, r)
        np.minimum.at(best, self.right, r)
        self.single = best <= self.ranks
        self._hash()
        # Characters: code point -> id, and those that stand in no longer piece and so end a segment.
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.piece.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(x) for x in inside]] = True
        self.mark = self.piece.get(MARK, -1)
        self.text = np.array([str(i).encode() for i in range(n)], dtype=object)
        self.runs: dict[int, np.ndarray] = {}

    def _hash(self) -> None:
        """Open table of pairs: two probes at the most for nearly all, chained by a linear step."""
        self.bits = 20
        size = 1 << self.bits
        self.slot_key, self.slot_made = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        key = self.left * (1 << 20) + self.right
        at, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.slot_key[at[put]], self.slot_made[at[put]] = key[put], self.made[put]
            todo = todo[self.slot_key[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or n."""
        key = a.astype(np.int64) * (1 << 20) + b
        at = self._slot(key)
        got = self.slot_key[at]
        out = np.where(got == key, self.slot_made[at], self.n).astype(np.int32)
        left = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at = (self._slot(key[left]) + _ + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at]
            hit = got == key[left]
            out[left[hit]] = self.slot_made[at[hit]]
            left = left[~hit & (got >= 0)]
        return out

    def merge(self, sym: np.ndarray, seg: np.ndarray, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
        """All rounds: symbols and their segment numbers in order, to the final symbols and segments."""
        done_sym, done_seg, done_at = [], [], []
        at = np.arange(len(sym))
        made = np.full(len(sym), self.n, np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(seg[1:] == seg[:-1])
            made[inner] = self.pairs(sym[inner], sym[inner + 1])
        while len(sym):
            rank = self.ranks[made]
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, first)
            live = least < _NONE
            size = np.diff(np.append(first, len(sym)))
            if not live.all():  # finished segments leave the arrays
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep]), done_seg.append(seg[~keep]), done_at.append(at[~keep])
                sym, seg, at, made, rank = sym[keep], seg[keep], at[keep], made[keep], rank[keep]
                least, size = least[live], size[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, size)
            pos = np.flatnonzero(hit)
            own = seg[pos]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            run = new | (np.concatenate([[0], pos[:-1]]) + 1 != pos)  # first of a run of neighbouring pairs
            start = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            take = ((np.arange(len(pos)) - start) & 1 == 0) & (new | ~self.single[made[pos]])
            pos = pos[take]
            sym[pos] = made[pos]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            # pairs to look up anew: the merged symbol with its right and its left neighbour
            stale = np.zeros(len(sym), bool)
            stale[pos] = True
            sym, seg, at, made, stale = sym[keep], seg[keep], at[keep], made[keep], stale[keep]
            stale[:-1] |= stale[1:]
            look = np.flatnonzero(stale)
            made[look] = self.n
            look = look[look + 1 < len(sym)]
            look = look[seg[look] == seg[look + 1]]
            made[look] = self.pairs(sym[look], sym[look + 1])
        order = np.argsort(np.concatenate(done_at), kind="stable") if done_at else np.zeros(0, np.int64)
        return (np.concatenate(done_sym)[order], np.concatenate(done_seg)[order]) if done_at else (sym, seg)

    def spaces(self, n: int) -> np.ndarray:
        """Ids of n space marks in a row, merged best score first and then leftmost."""
        if n not in self.runs:
            parts = [MARK] * n
            made = lambda i: self.piece.get(parts[i] + parts[i + 1])
            done: list[int] = []  # lengths that can't grow any more
            longest = max((len(p) for p in self.piece if not p.strip(MARK)), default=1)
            if all(self.rank[self.piece[p]] == self.rank[self.piece[MARK * 2]] for p in self.piece if len(p) > 1 and not p.strip(MARK)):
                # One rank: the leftmost pair always merges, so whole longest pieces leave on the left.
                whole, rest = (n // longest, n % longest) if MARK * longest in self.piece else (0, n)
                done, parts = [longest] * whole, [MARK] * rest
            while True:
                options = [(self.rank[m], i) for i in range(len(parts) - 1) if (m := made(i)) is not None]
                if not options:
                    break
                i = min(options)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.runs[n] = np.array([self.piece[MARK * k] for k in done] + [self.piece[p] for p in parts], np.int64)
        return self.runs[n]


class PieceEncoder:
    def __init__(self, path: str):
        self.m = PieceModel(path)
        self.keys, self.at, self.len, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids per document and all ids, without end ids."""
        m = self.m
        n_doc = len(c)
        text = c.buf.tobytes().decode("utf-8", "replace")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(code):
            return np.zeros(n_doc, np.int64), np.zeros(0, np.int64)
        lead = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
        offs = lead[c.offs]
        # a mark before every document that isn't empty, spaces become marks
        code[code == 32] = ord(MARK)
        filled = np.flatnonzero(np.diff(offs) > 0)
        code = np.insert(code, offs[filled], ord(MARK))
        size = np.diff(offs) + (np.diff(offs) > 0)
        offs = np.concatenate([[0], np.cumsum(size)])
        n = len(code)
        is_mark = code == ord(MARK)
        loose = ~m.joins[code] & ~is_mark
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        cut[1:n] |= is_mark[1:] | loose[1:] | loose[:-1]
        s = np.flatnonzero(cut[:n])
        e = np.append(s[1:], n)
        docs = np.searchsorted(offs, s, "right") - 1
        # distinct segments
        h, first, which = np.unique(spans_hash(code, s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        fs, fe = s[first[new]], e[first[new]]
        pick = ragged(fs, fe - fs)
        seg = np.repeat(np.arange(len(new)), fe - fs)
        chars = code[pick]
        sym = m.char[chars].astype(np.int32)
        odd = np.flatnonzero(sym < 0)
        sym[odd] = m.n + 1 + np.arange(len(odd), dtype=np.int32) % 1000  # no pair has these
        got, own = m.merge(sym, seg, len(new)) if len(sym) else (sym, seg)
        if len(odd):  # a segment with a character that is no piece is that character alone
            data = [chr(x).encode("utf-8", "replace") for x in chars[odd].tolist()]
            lone = seg[odd]
            keep = got <= m.n
            got = np.concatenate([got[keep], np.array([m.bytes[b] for d in data for b in d], np.int32)])
            own = np.concatenate([own[keep], np.repeat(lone, [len(d) for d in data])])
            order = np.argsort(own, kind="stable")
            got, own = got[order], own[order]
        count = np.bincount(own, minlength=len(new)).astype(np.int64)
        pos = np.cumsum(count) - count + len(self.ids)
        where, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        where[known], size[known] = self.at[at[known]], self.len[at[known]]
        where[new], size[new] = pos, count
        flat = np.concatenate([self.ids, got.astype(np.int32)])
        if len(self.keys) + len(new) <= MEMO:
            self.ids = flat
            keys = np.concatenate([self.keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.len = keys[order], np.concatenate([self.at, pos])[order], np.concatenate([self.len, count])[order]
        size_of, where_of = size[which], where[which]
        # runs of marks: all segments of one mark alone, and a following one that kept its mark as a symbol
        bare = (e - s == 1) & is_mark[s]
        if bare.any():
            starts_mark = is_mark[s] & (flat[where_of] == m.mark)
            begin = bare & ~np.concatenate([[False], bare[:-1] & (docs[1:] == docs[:-1])])
            extra, parts_at, parts_len = [], where_of.copy(), size_of.copy()
            base = len(flat)
            for i in np.flatnonzero(begin).tolist():
                j = i
                while j < len(s) and bare[j] and docs[j] == docs[i]:
                    j += 1
                k = j - i
                if j < len(s) and docs[j] == docs[i] and starts_mark[j]:
                    k += 1
                    parts_at[j] += 1
                    parts_len[j] -= 1
                ids = m.spaces(k)
                parts_at[i], parts_len[i] = base, len(ids)
                parts_len[i + 1 : j] = 0
                extra.append(ids)
                base += len(ids)
            flat = np.concatenate([flat, *extra])
            where_of, size_of = parts_at, parts_len
        per = np.bincount(docs, size_of, n_doc).astype(np.int64)
        return per, flat[ragged(where_of, size_of)].astype(np.int64)


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, model: str | None = None, end: bool = True) -> DataFrame:
    """doc_id and ids of every whole text."""
    file, out = tokenizer_file(MODEL, model), schema("doc_id:long,ids:longs")

    def run(batches):
        enc = piece_encoder(file)
        for b in batches:
            for c in chunks(b.column(1), 1 << 20):
                per, ids = enc.encode(c)
                tail = [enc.m.end] if end else []
                at = np.concatenate([[0], np.cumsum(per)])
                yield table(out, doc_id=b.column(0).slice(c.lo, len(c)), ids=[ids[i:j].tolist() + tail for i, j in zip(at, at[1:])])

    return texts(docs).mapInArrow(released(run), out)


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give the empty text."""
    file, out = tokenizer_file(MODEL, model), schema("doc_id:long,text:string")

    def run(batches):
        lib = piece_encoder(file).m.lib
        for b in batches:
            yield table(out, doc_id=b.column(0), text=[lib.decode(x or []) for x in b.column(1).to_pylist()])

    return rows.select("doc_id", "ids").mapInArrow(released(run), out)


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the decimal ids and of the decoded text, in one pass."""
    file = tokenizer_file(MODEL, model)

    def run(batches):
        enc = piece_encoder(file)
        name, lib, end = enc.m.text, enc.m.lib, enc.m.end
        for b in batches:
            for c in chunks(b.column(1)):
                per, ids = enc.encode(c)
                at = np.concatenate([[0], np.cumsum(per)]).tolist()
                n, a, d = [], [], []
                for i, j in zip(at, at[1:]):
                    own = ids[i:j].tolist() + [end]
                    n.append(len(own))
                    a.append(hashlib.sha256(b" ".join([name[x] for x in own])).hexdigest())
                    d.append(hashlib.sha256(lib.decode(own).encode()).hexdigest())
                yield table(IDS, doc_id=b.column(0).slice(c.lo, len(c)), n_tokens=n, ids_sha256=a, decoded_sha256=d)

    return texts(docs).mapInArrow(released(run), IDS)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_digests(read_texts(spark, sf_dir))
