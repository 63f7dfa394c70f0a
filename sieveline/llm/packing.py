"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Each document is tokenised once and cut into pieces of at most `max_len` tokens, so only longer documents are cut.
Pieces are dealt into shards of bounded size by a hash of the row, so neither a hot source nor a group of copies can fill
a shard, and each shard is packed on its own: a bin is filled greedily with the largest pieces that fit; then its smallest
piece gives way to two unpacked pieces if these fit the widened gap more tightly. A shard needs one open bin at most, so
sharding costs less than a bin in some thousands.

Defined cases: a null or empty text is the end token alone; an empty table gives no rows; rows that repeat (also in their
id) are packed as often as they occur; ids may be null; other columns are ignored, whatever their names. Memory: one
document and its tokens, and a shard of piece lengths.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import each_utf8, mapped, ship, slices, stash

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLANK = re.compile(rb"[\x20\x09-\x0d]")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts whose ids must be those of their parts, one after the other.
FITTING = {"The cat, (it's) 12 MEN... don't": ["the", "cat", ",", "(", "it", "'s", ")", "1", "2", "men", "...", "don", "'t"], "x\n\n y\tZ": ["x", "y", "z"], "a-b, c": ["a", "-", "b", ",", "c"]}
#: Bytes of text that are encoded at once.
RUN = 1 << 21
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordTokens:
    """Token ids as little-endian bytes, by white-space separated word; exact for a tokenizer that lower-cases, drops white space
    and splits letters from what is neither letter nor digit. Others are refused.

    Words of letters are encoded together, and their ids are split after those tokens that end a word; marks after a word
    are looked up apart. Other words, and all if the split doesn't fit, are encoded one by one. Words that occur
    twice in a run of texts are kept; when the table holds `limit` it becomes the old one, from which words come back as they occur again.
    Words of over 64 bytes are not kept.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.limit, self.known, self.old = Tokenizer.from_file(path), limit, {}, {}
        self.plain = Tokenizer.from_file(path)  # the same for words of a-z, which need no normalisation and stand for their own bytes
        if not self._fits():
            raise ValueError(f"{path}: its tokens are not those of the words one by one")
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _fits(self) -> bool:
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        return all(ids(text) == [i for part in parts for i in ids(part)] for text, parts in FITTING.items())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        plain = pc.if_else(pc.match_substring(plain, "<|"), plain, pc.ascii_lower(plain))  # a special token's string stays as it is
        split = pc.ascii_split_whitespace(plain)
        coded, ends = split.values.dictionary_encode(), split.offsets.to_numpy()
        at = coded.indices.to_numpy()
        values = self._values(coded.dictionary.cast(pa.large_binary()).to_pylist(), np.bincount(at, minlength=len(coded.dictionary)) > 1)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        upto = np.concatenate(([0], np.cumsum(sizes[at])))
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - upto[:-1], sizes[at])
        place += np.arange(len(place))
        ids, cuts = np.frombuffer(b"".join(values), "<u4")[place], upto[ends].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _values(self, words: list[bytes], often: np.ndarray) -> list[bytes]:
        """The ids of distinct words; those that occur often are kept, and those that came back."""
        out = list(map(self.known.get, words))
        new = [w for w, v in zip(words, out, strict=True) if v is None]
        if not new:
            return out
        found = self._ids(new)
        kept = [(w, found[w]) for w, v, more in zip(words, out, often.tolist(), strict=True) if v is None and (more or w in self.old) and len(w) <= 64]
        if len(self.known) + len(kept) > self.limit:
            self.old, self.known = self.known, {}
        self.known.update(kept)
        return [found[w] if v is None else v for w, v in zip(words, out, strict=True)]

    def _ids(self, new: list[bytes]) -> dict[bytes, bytes]:
        old, known = self.old, self.known
        found = {w: old[w] for w in new if w in old}
        cores, letters, one, need = [], [], [], set()
        for w in new if not found else [w for w in new if w not in found]:
            c = w.rstrip(MARKS)
            if c and (c.isalpha() or not c.isascii() and c.decode().isalpha()) and (c.islower() or c == c.lower() or c is w and not c.isascii()):
                if len(c) == len(w):
                    letters.append(w)
                else:
                    cores.append((w, c, w[len(c) :]))
                    need.add(c)
                    need.add(cores[-1][2])
            else:
                one.append(w)
        need.difference_update(letters, one)
        for w in need:
            if w in known:
                found[w] = known[w]
            elif w in old:
                found[w] = old[w]
            else:
                (letters if w[-1] not in MARKS else one).append(w)
        found |= self._together([w for w in letters if w.isascii()], self.plain) | self._together([w for w in letters if not w.isascii()], self.tokenizer)
        found.update(zip(one, self._each(one), strict=True))
        found.update([(w, found[c] + found[m]) for w, c, m in cores])
        return found

    def _each(self, words: list[bytes]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _together(self, words: list[bytes], tokenizer) -> dict[bytes, bytes]:
        if not words:
            return {}
        ids = np.asarray(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return dict(zip(words, self._each(words), strict=True))
        raw, at = ids.tobytes(), [0, *ends.tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, at[:-1], at[1:], strict=True)}


@lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    """One table for all tasks of a worker."""
    return WordTokens(path)


def runs(texts, size: int):
    """The texts, in lists of about `size` bytes, each as its parts: longer ones are split where white space is."""
    own, total = [], 0
    for text in texts:
        at, parts = 0, []
        while len(text) - at > size and (end := BLANK.search(text, at + size)):
            parts.append(text[at : end.start()])
            at = end.end()
        parts.append(text[at:] if at else text)
        own.append(parts)
        total += len(text)
        if total >= size:
            yield own
            own, total = [], 0
    if own:
        yield own


def pieces(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, number, start in the document's ids, length and the ids' CRC-32."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words, end = word_tokens(path), np.asarray([end_id], "<u4").tobytes()

        def whole(own):
            if len(own) == 1:  # perhaps a long one
                return [b"".join(words.encode([part])[0] for part in own[0])]
            last = [b"".join(words.encode([part])[0] for part in own[-1])] if len(own[-1]) > 1 else []
            return words.encode([parts[0] for parts in own[: len(own) - len(last)]]) + last

        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            encoded = (ids for own in runs(each_utf8(batch.column(1)), RUN) for ids in whole(own))
            for doc, ids in zip(docs, encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    own = ids[at : at + 4 * max_len]
                    out.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            doc, k, at, n, crc = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, n, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the lengths (1 to capacity)."""
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    for rows in waiting.values():
        rows.reverse()  # taken from the end: the later rows of a length come last
    sizes = sorted(waiting)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(size: int) -> int:
        row = waiting[size].pop()
        if not waiting[size]:
            del waiting[size]
            del sizes[bisect_right(sizes, size) - 1]
        return row

    def back(size: int, row: int) -> None:
        if size not in waiting:
            insort(sizes, size)
        waiting.setdefault(size, []).append(row)

    number = 0
    while sizes:
        own, gap = [], capacity
        while gap and (k := bisect_right(sizes, gap)):
            size = sizes[k - 1]
            own.append((size, take(size)))
            gap -= size
        if gap and len(sizes) > 0 and len(own) > 0:
            least = own[-1][0]  # pieces were added from large to small
            wide, have = gap + least, np.asarray(sizes)
            first = have[have <= wide // 2]
            if len(first):
                at = np.searchsorted(have, wide - first, side="right") - 1
                second = have[at]
                alone = second == first
                for i in np.flatnonzero(alone).tolist():
                    alone[i] = len(waiting[int(first[i])]) < 2
                second = np.where(alone, np.where(at > 0, have[np.maximum(at - 1, 0)], 0), second)
                fit = np.where((second > 0) & ((second != first) | ~alone), first + second, 0)
                best = int(np.argmax(fit))
                if fit[best] > least:
                    size, row = own.pop()
                    for x in (int(second[best]), int(first[best])):
                        own.append((x, take(x)))
                    back(size, row)
        at = 0
        for size, row in own:
            bins[row], offsets[row] = number, at
            at += size
        number += 1
    return bins, offsets


def pack(cut: DataFrame, max_len: int = 4096, shard_rows: int = 16384) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` is read twice, so it should be stored."""
    ship(cut.sparkSession)
    shards = slices(cut.count(), shard_rows)

    def solve(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), max_len)
        pdf["sequence_id"] = (int(pdf["shard"].iloc[0]) << 40) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns=["shard"])

    row = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    return cut.withColumn("shard", F.pmod(row, F.lit(shards))).groupBy("shard").applyInPandas(solve, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 16384) -> DataFrame:
    """Tokenise, cut and pack whole documents; see the module's docstring for the defined cases."""
    return pack(stash(pieces(docs, tokenizer_path, max_len, end_id, id_col, text_col)), max_len, shard_rows)
