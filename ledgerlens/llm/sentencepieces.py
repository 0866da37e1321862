"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text with a leading space is cut before each run of spaces; no piece of the
vocabulary crosses such a cut, so the best segmentation of the text is that of its
words. The new words of a batch of texts are encoded together: words of equal length
form one array and advance together, character by character. Rolling hashes of their
substrings probe the sorted hashes of the pieces of that length; a hit is compared
character by character, so results are exact. A vectorised maximum over the pieces
that end at a place keeps score and backpointer. Of equal scores the longer piece wins.
Characters that no piece holds become byte pieces. Words met before come from a memory
of bounded size. A long word (a text without spaces, however long) is probed at all its places
at once for each piece length and cut wherever no piece that it holds crosses, which changes no
segmentation; the cuts are words like any others, and one that is still long takes its maxima
place by place over the pieces found in it.

Decoding is exact: decode(encode(t)) == t for every text. A null text gives null ids
and null back, an empty text no ids. Repeated rows, null ids of rows and extra columns
make no difference. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, LITERAL = 0x2581, 0x110000  # the piece character for a space; a code for that character itself in a text
BASE = np.uint64(0x100000001B3)
#: Words remembered by a task, most characters of one array of words, and the score of a character that needs bytes.
MEMORY, CELLS, UNKNOWN = 500_000, 1 << 19, -10.0
#: Characters of a word that is cut, or goes alone.
LONG = 64
#: Leading bits of a hash by which pieces are marked.
MARKS = 18
_WORD = re.compile(" *[^ ]+| +")


class Pieces:
    """A vocabulary file's pieces, sorted by hash for each length."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = [0] * 256
        by_length: dict[int, list] = defaultdict(list)
        self.byte_of: dict[int, int] = {}
        low = 0.0
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if re.search("[^▁]▁", p):
                    raise ValueError("a piece that crosses a space isn't supported")
                by_length[len(p)].append((p, i, sp.get_score(i)))
                low = min(low, sp.get_score(i))
        self.unknown = low + UNKNOWN
        self.table = {}
        for n, found in by_length.items():
            codes = np.array([[ord(c) for c in p] for p, _, _ in found], np.uint32).T
            h = substring_hashes(prefix_hashes(codes), 0, n)
            order = np.argsort(h)
            marked = np.zeros(1 << MARKS, bool)  # most substrings are no pieces: one look here spares them the search
            marked[h >> np.uint64(64 - MARKS)] = True
            self.table[n] = (h[order], codes[:, order], np.array([i for _, i, _ in found])[order], np.array([s for _, _, s in found])[order], marked)
        self.longest = max(self.table)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace("▁", " ").encode() for i, p in enumerate(self.text)]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(length + 1, words) rolling hashes of the prefixes of words of equal length; ``codes`` has a row for each place."""
    h = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    for j in range(codes.shape[0]):
        h[j + 1] = h[j] * BASE + codes[j].astype(np.uint64)
    return h


def substring_hashes(prefix: np.ndarray, start: int, end: int) -> np.ndarray:
    power = np.uint64(pow(int(BASE), end - start, 1 << 64))
    return prefix[end] - prefix[start] * power


def codes_of(words: list[str]) -> np.ndarray:
    """The characters of words of equal length, a row for each place, a column for each word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
    flat = np.ascontiguousarray(flat.T)
    return np.select([flat == ord(" "), flat == SPACE], [np.uint32(SPACE), np.uint32(LITERAL)], flat).astype(np.uint32)


def viterbi(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the best piece ids of words of equal length, one word after the other, and how many each has.

    A character that needs bytes has -1 - code for an id.
    """
    n, m = codes.shape
    prefix = prefix_hashes(codes)
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0
    back, via = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int64)
    for end in range(1, n + 1):
        top = best[end - 1] + pieces.unknown
        start = np.full(m, end - 1, np.int32)
        piece = -1 - codes[end - 1].astype(np.int64)
        for size in range(1, min(end, pieces.longest) + 1):
            if size not in pieces.table:
                continue
            h, letters, ids, scores, marked = pieces.table[size]
            mine = substring_hashes(prefix, end - size, end)
            hit = np.nonzero(marked[mine >> np.uint64(64 - MARKS)])[0]
            if not len(hit):
                continue
            at = np.minimum(np.searchsorted(h, mine[hit]), len(h) - 1)
            found = h[at] == mine[hit]
            hit, at = hit[found], at[found]
            score = best[end - size][hit] + scores[at]
            won = (letters[:, at] == codes[end - size:end, hit]).all(axis=0) & (score >= top[hit])
            hit, at = hit[won], at[won]
            top[hit], start[hit], piece[hit] = score[won], end - size, ids[at]
        best[end], back[end], via[end] = top, start, piece
    words, place, taken = np.arange(m), np.full(m, n), []
    while (place > 0).any():  # all words step back together
        taken.append(np.where(place > 0, via[place, words], np.iinfo(np.int64).max))
        place = back[place, words]
    grid = np.stack(taken[::-1], axis=1)
    real = grid != np.iinfo(np.int64).max
    return grid[real], real.sum(axis=1)


def found_pieces(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, sizes, ids, scores) of all pieces in one word, by end, then size."""
    n = len(codes)
    power, prefix = np.full(n + 1, BASE, np.uint64), np.zeros(n + 1, np.uint64)
    power[0] = 1
    power = power.cumprod()
    inverse = np.full(n, pow(int(BASE), -1, 1 << 64), np.uint64).cumprod()
    prefix[1:] = (codes.astype(np.uint64) * inverse).cumsum() * power[1:]  # as prefix_hashes, without its loop
    out = []
    for size, (h, letters, ids, scores, marks) in pieces.table.items():
        if size > n:
            continue
        mine = prefix[size:] - prefix[:-size] * power[size]
        at = np.nonzero(marks[mine >> np.uint64(64 - MARKS)])[0]
        which = np.minimum(np.searchsorted(h, mine[at]), len(h) - 1)
        same = h[which] == mine[at]
        at, which = at[same], which[same]
        same = np.ones(len(at), bool)
        for j in range(size):
            same &= letters[j, which] == codes[at + j]
        at, which = at[same], which[same]
        out.append((at + size, np.full(len(at), size), ids[which], scores[which]))
    ends, sizes, ids, scores = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4))
    order = np.lexsort((sizes, ends))
    return ends[order], sizes[order], ids[order], scores[order]


def cuts(word: str, pieces: Pieces) -> list[str]:
    """The parts of a word between the places that no piece in it crosses."""
    ends, sizes, _, _ = found_pieces(codes_of([word])[:, 0], pieces)
    crossed = np.zeros(len(word) + 1, np.int64)
    np.add.at(crossed, ends - sizes + 1, 1)
    np.subtract.at(crossed, ends, 1)
    at = [*np.nonzero(crossed[:len(word)].cumsum()[1:] == 0)[0] + 1, len(word)]
    return [word[lo:hi] for lo, hi in zip([0, *at], at)]


def viterbi_alone(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The ids that ``viterbi`` gives, for one long word, over the pieces found in it."""
    codes, n = codes[:, 0], len(codes)
    ends, sizes, ids, scores = found_pieces(codes, pieces)
    first = np.searchsorted(ends, np.arange(n + 2)).tolist()
    sizes, ids, scores = sizes.tolist(), ids.tolist(), scores.tolist()
    best, start, via = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for end in range(1, n + 1):
        top, size, piece = best[end - 1] + pieces.unknown, 1, None
        for x in range(first[end], first[end + 1]):
            score = best[end - sizes[x]] + scores[x]
            if score >= top:
                top, size, piece = score, sizes[x], ids[x]
        best[end], start[end], via[end] = top, end - size, -1 - int(codes[end - 1]) if piece is None else piece
    out, at = [], n
    while at:
        out.append(via[at])
        at = start[at]
    return np.array(out[::-1], np.int64)


class Codec:
    """Encodes and decodes texts; remembers words."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.memory: dict[str, bytes] = {}

    def _bytes_of(self, code: int) -> list[int]:
        c = "▁" if code == LITERAL else " " if code == SPACE else chr(code)
        return [self.pieces.byte[b] for b in c.encode("utf-8", "surrogatepass")]

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for n, group in by_length.items():
            step = max(1, CELLS // n)
            for at in range(0, len(group), step):
                some = group[at:at + step]
                if n > LONG:
                    alone = [viterbi_alone(codes_of([w]), self.pieces) for w in some]
                    ids, counts = np.concatenate(alone), np.array([len(x) for x in alone])
                else:
                    ids, counts = viterbi(codes_of(some), self.pieces)
                ends = np.cumsum(counts)
                odd = set((np.searchsorted(ends, np.nonzero(ids < 0)[0], "right")).tolist())
                raw = np.maximum(ids, 0).astype("<u4").tobytes()
                lo = 0
                for r, (w, hi) in enumerate(zip(some, ends.tolist(), strict=True)):
                    if r in odd:
                        flat = [x for i in ids[lo:hi].tolist() for x in ([i] if i >= 0 else self._bytes_of(-1 - i))]
                        self.memory[w] = np.array(flat, "<u4").tobytes()
                    else:
                        self.memory[w] = raw[4 * lo:4 * hi]
                    lo = hi

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        cut = [_WORD.findall(" " + t) if t else [] for t in texts]
        if any(len(w) > LONG for c in cut for w in c):
            cut = [[x for w in c for x in (cuts(w, self.pieces) if len(w) > LONG else (w,))] for c in cut]
        new = set().union(*cut).difference(self.memory)
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = set().union(*cut)
        self._learn(new)
        return [None if t is None else b"".join([self.memory[w] for w in c]) for t, c in zip(texts, cut, strict=True)]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        raw = self.pieces.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "surrogatepass")[1:]


def public_codec() -> Codec:
    """The public 32k piece vocabulary, from wherever the machine that runs this has it."""
    import public_tokenizers

    return Codec(public_tokenizers.path("piece_bpe_32k.model"))


#: Characters of the texts that are encoded together; a longer text goes alone.
TOGETHER = 1 << 22


def _map(df: DataFrame, make, f, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            values, at = batch.column(1).to_pylist(), 0
            while at < len(values):
                end, size = at, 0
                while end < len(values) and (end == at or size + len(values[end] or "") <= TOGETHER):
                    size += len(values[end] or "")
                    end += 1
                cols = f(codec, values[at:end])
                own = batch.column(0).slice(at, end - at).cast(arrow.types[0])
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(cols, arrow.types[1:], strict=True))], schema=arrow)
                at = end

    return df.mapInArrow(task, schema)


def _ids(raw: bytes | None) -> np.ndarray | None:
    return None if raw is None else np.frombuffer(raw, "<u4").astype(np.int32)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make=public_codec) -> DataFrame:
    """(id, ids) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), make,
                lambda codec, texts: [[_ids(x) for x in codec.encode(texts)]], f"id {kind}, ids array<int>")


def decode(tokens: DataFrame, id_col: str = "id", ids_col: str = "ids", make=public_codec) -> DataFrame:
    """(id, text) for every row of (id, ids)."""
    kind = tokens.schema[id_col].dataType.simpleString()
    return _map(tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make,
                lambda codec, rows: [[None if r is None else codec.decode(np.array(r, "<u4").tobytes()) for r in rows]], f"id {kind}, text string")


def token_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make=public_codec) -> DataFrame:
    """(id, n_tokens, n_bytes, ids_crc32, same): tokens, byte pieces among them, checksum of the ids, and whether decoding gave the text back."""
    import zlib

    def report(codec, texts):
        raw = codec.encode(texts)
        is_byte = np.zeros(len(codec.pieces.text), bool)
        is_byte[list(codec.pieces.byte_of)] = True
        some = [x or b"" for x in raw]
        return [[len(x) // 4 for x in some], [int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in some], [zlib.crc32(x) for x in some],
                [codec.decode(x) == t for x, t in zip(raw, texts, strict=True)]]

    kind = docs.schema[id_col].dataType.simpleString()
    return _map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), make, report,
                f"id {kind}, n_tokens bigint, n_bytes bigint, ids_crc32 bigint, same boolean")
