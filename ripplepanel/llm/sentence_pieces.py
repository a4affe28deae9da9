"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut where no piece of the model reaches across: both sides are encoded on their own with the same
result. The distinct stretches ("words") of a block that are not known yet are grouped by length, and all words of a
length advance together, one character at a time. For each end and each piece length a rolling hash of the
substring is looked up among the sorted hashes of the pieces, and the best way to reach the end is kept as a
vectorised maximum with its back pointer.

Unigram models: the sum of piece scores is maximised. Merge (BPE) models: a sequence is the merge result exactly
if each two neighbours, merged on their own, stay apart; so a step scores 0 if its two pieces stay apart and is
closed otherwise, and one path is left. Whether two pieces stay apart is found once per pair by running both
pieces' own merges against the merges across their border. Unknown characters become their bytes where the model
has byte pieces, else the unknown piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.llm.common import chunks, texts

SPACE = "▁"
KNOWN = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BORDER_BITS = 22
#: Symbols of characters that are no piece: this plus the code point.
_CHARACTER = 1 << 21
_SYMBOL_BITS = 22


def _hash_codes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of code points; column i covers the first i characters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PieceModel:
    """A model file of the identity or no normalisation kind, ready for search."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as formats

        proto = formats.ModelProto()
        proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        spec, kinds = proto.normalizer_spec, proto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for the space sign, are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if not self.merges and proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM:
            raise ValueError("a unigram or merge model is needed")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces])
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        out = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in proto.pieces]
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        self.out = out
        self.longest = max(map(len, self.ids))
        self.low = float(self.scores.min()) - 10
        by_length: dict[int, list[str]] = {}
        for piece in self.ids:
            by_length.setdefault(len(piece), []).append(piece)
        self.tables = {}
        border = np.zeros(1 << _BORDER_BITS, bool)
        for n, found in sorted(by_length.items()):
            codes = np.stack([_codes(p) for p in found])
            keys, ids = _hash_codes(codes)[:, n], np.array([self.ids[p] for p in found])
            order = np.argsort(keys)
            self.tables[n] = keys[order], ids[order], np.uint64(pow(int(_BASE), n, 1 << 64))
            for k in range(n - 1):
                border[self._border(codes[:, k], codes[:, k + 1])] = True
        # for a length without pieces: one key that stands for none
        self.nothing = np.full(1, 2**64 - 1, np.uint64), np.zeros(1, np.int64), np.uint64(0)
        self.border = border
        self.words: dict[str, bytes] = {}
        self.edges: dict[int, list[tuple[float, str, str]]] = {}
        self.forget_pairs()

    def forget_pairs(self) -> None:
        """The sorted keys of pairs, and whether each stays apart; one entry that no pair has comes first."""
        self.pairs, self.open = np.full(1, -1, np.int64), np.zeros(1, bool)

    @staticmethod
    def _border(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A slot for two neighbouring characters; shared slots only make stretches longer."""
        return (((left << np.uint64(21)) ^ right) * _BASE >> np.uint64(64 - _BORDER_BITS)).astype(np.int64)

    def own_merges(self, symbol: int) -> list[tuple[float, str, str]]:
        """A piece's own merges: the score of the next one, and its first and last part before it."""
        if symbol not in self.edges:
            parts = list(chr(symbol - _CHARACTER) if symbol >= _CHARACTER else self.pieces[symbol])
            steps = []
            while True:
                best, at = -np.inf, -1
                for i in range(len(parts) - 1):
                    joined = self.ids.get(parts[i] + parts[i + 1])
                    if joined is not None and self.scores[joined] > best:
                        best, at = self.scores[joined], i
                steps.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            # a piece that its own merges do not produce is never a result
            self.edges[symbol] = steps if len(parts) == 1 else []
        return self.edges[symbol]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces again."""
        a, b = self.own_merges(left), self.own_merges(right)
        if not a or not b:
            return False
        i = j = 0
        while True:
            joined = self.ids.get(a[i][2] + b[j][1])
            across = -np.inf if joined is None else self.scores[joined]
            # equal scores are equal pieces, and the leftmost goes first
            if i + 1 < len(a) and a[i][0] >= across and a[i][0] >= b[j][0]:
                i += 1
            elif j + 1 < len(b) and b[j][0] > across:
                j += 1
            else:
                return joined is None

    def _steps_open(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stay_apart`` for arrays of symbols; a start (-1) is open to every symbol that merges to itself."""
        keys = (left + 1 << _SYMBOL_BITS) | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        fresh = np.unique(keys[self.pairs[at] != keys])
        if len(fresh):
            answers = [bool(self.own_merges(y)) if x < 0 else self.stay_apart(x, y) for x, y in zip(
                ((fresh >> _SYMBOL_BITS) - 1).tolist(), (fresh & (1 << _SYMBOL_BITS) - 1).tolist(), strict=True)]
            where = np.searchsorted(self.pairs, fresh)
            self.pairs, self.open = np.insert(self.pairs, where, fresh), np.insert(self.open, where, answers)
            at = np.searchsorted(self.pairs, keys)
        return self.open[at]

    def search(self, group: list[str]) -> list[list[int]]:
        """The best symbols of words of one length."""
        codes = np.stack([_codes(w) for w in group])
        n, size = codes.shape
        rows, prefix = np.arange(n), _hash_codes(codes)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, size + 1), -1, np.int64)
        back = np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            most = min(self.longest, end)
            symbol, total = np.zeros((most, n), np.int64), np.full((most, n), -np.inf)
            for length in range(1, most + 1):
                start = end - length
                table, ids, power = self.tables.get(length, self.nothing)
                keys = prefix[:, end] - prefix[:, start] * power
                at = np.searchsorted(table, keys)
                at[at == len(table)] = 0
                hit = table[at] == keys
                found = ids[at[hit]]
                symbol[length - 1, hit] = found
                total[length - 1, hit] = best[hit, start] if self.merges else best[hit, start] + self.scores[found]
                if length == 1:  # an unknown character stands for itself
                    symbol[0, ~hit] = _CHARACTER + codes[~hit, start].astype(np.int64)
                    total[0, ~hit] = best[~hit, start] + (0.0 if self.merges else self.low)
            if self.merges:
                step, row = np.nonzero(total > -np.inf)
                open_ = self._steps_open(last[row, end - 1 - step], symbol[step, row])
                total[step[~open_], row[~open_]] = -np.inf
            chosen = total.argmax(axis=0)
            best[:, end], last[:, end], back[:, end] = total[chosen, rows], symbol[chosen, rows], end - 1 - chosen
        paths: list[list[int]] = []
        for row in range(n):
            end, path = size, []
            while end > 0:
                path.append(int(last[row, end]))
                end = int(back[row, end])
            paths.append(path[::-1])
        return paths

    def _ids_of(self, symbols: list[int]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            if s < _CHARACTER:
                ids.append(s)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(s - _CHARACTER).encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknown characters are one piece
                ids.append(self.unknown)
        return ids

    def learn(self, fresh: Iterable[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            rows = max(1, 2_000_000 // (n + 1) // 32)  # the search's arrays hold a few numbers per character
            for i in range(0, len(group), rows):
                few = group[i : i + rows]
                for w, symbols in zip(few, self.search(few), strict=True):
                    self.words[w] = np.array(self._ids_of(symbols), np.int32).tobytes()

    def stretches(self, text: str) -> list[str]:
        """The text with space signs, cut where no piece reaches across."""
        if not text:
            return []
        plain = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        codes = _codes(plain)
        cuts = (np.flatnonzero(~self.border[self._border(codes[:-1], codes[1:])]) + 1).tolist()
        return list(map(plain.__getitem__, map(slice, [0, *cuts], [*cuts, len(plain)])))

    def encode(self, block: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        cut = [self.stretches(t) for t in block]
        if len(self.words) > KNOWN:
            self.words.clear()
        if len(self.pairs) > 10 * KNOWN:
            self.forget_pairs()
        self.learn(set().union(*cut) - self.words.keys())
        merged = [b"".join(map(self.words.__getitem__, words)) for words in cut]
        if self.bytes is None and not self.merges:
            merged = [self._one_unknown(m) for m in merged]
        return merged

    def _one_unknown(self, raw: bytes) -> bytes:
        ids = np.frombuffer(raw, np.int32)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
        return ids[keep].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; control pieces have none, bytes that are no character become a replacement sign."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_pieces``, ``ids`` and ``round_trip`` for every row of ``docs``.

    A null or empty text has no ids. ``round_trip`` says whether decoding gives the text again; a text with the space
    sign of the pieces itself does not. Repeated rows and null ids keep a row each; other columns are not read.
    """
    rows = texts(docs.select(*(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)), F.col(text).alias("text")),
                 keys=tuple(f"keep_{i}" for i in range(len(keep))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            for block in chunks(batch):
                said = block.column("text").to_pylist()
                raw = model.encode(said)
                same = [model.decode(memoryview(r).cast("i").tolist() if r else []) == t for r, t in zip(raw, said, strict=True)]
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [*(block.column(c) for c in block.schema.names if c != "text"), pa.array(sizes), ids, pa.array(same, pa.bool_())],
                    [*(c for c in block.schema.names if c != "text"), "n_pieces", "ids", "round_trip"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != "text")
    out = rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n_pieces long, ids array<int>, round_trip boolean")
    return out.select(*(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)), "n_pieces", "ids", "round_trip")


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``text`` of rows of ids; null or no ids give an empty text, a null id none."""
    source = rows.select(*(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)), F.col(ids).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            said = [model.decode(i for i in r or () if i is not None) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(said, pa.string())], [*batch.schema.names[:-1], "text"])

    kinds = ", ".join(f"{c} {k}" for c, k in source.dtypes if c != "ids")
    out = source.mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string")
    return out.select(*(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)), "text")
