"""Token-id files compressed by Re-Pair grammars, with random access.

Documents are range-partitioned by id; each range is cut into shards of a bounded number of ids. In a shard, frequent
pairs of neighbouring symbols are replaced by new symbols (nonterminals) until no pair is frequent. A row of the files
holds one shard: its documents' ids and symbol offsets, the symbols, the rules (left, right) in order of creation, and for
each rule the number of ids that it expands to, so that any stretch of any document can be decoded alone (read_stretch).

Pairs never cross a document's end. Each round replaces many pairs at once, the most frequent ones first where they overlap.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, new_path, table
from .token_counts import model_path

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: Ids in a shard, before which it is closed; one longer document makes a shard of its own.
SHARD_IDS = 1_000_000
#: Places from which on a pair is frequent: a rule takes about as many bytes as four symbols.
MIN_COUNT = 8
#: Words that a worker remembers, about 200 bytes each; then it starts anew.
MAX_WORDS = 1_500_000
#: Bytes of text in a range of ids, about; there are as many ranges as the session's shuffle partitions at least.
PART_BYTES = 128 << 20
#: part: the number of the range that a shard belongs to; ids_before: ids of the range before the shard; first_doc, last_doc: its least and largest id.
SHARD_SCHEMA = "part int, ids_before long, n_ids long, first_doc long, last_doc long, doc_ids binary, doc_nulls binary, doc_symbols binary, doc_lengths binary, symbols binary, width int, left binary, right binary, lengths binary, base int"


# --- encoding --------------------------------------------------------------------------------------------------------
#: A space before one of these characters always begins a pre-token of the byte-level pattern, so a text can be cut there.
SAFE = r"[!-~\xa1-\xac\xae-ᙿ]"
CUT = re.compile(f"(?= {SAFE})")
#: Words, with the line break before them if there is one, of texts that are lines of words with single spaces. Elsewhere white space is a pre-token of its own.
OPENS = re.compile(rf"\n?{SAFE}")
#: A word's letters and the ASCII marks after them are pre-tokens of their own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word that the pattern takes for letters, and marks after them.
LETTERS = re.compile(rf"\n?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+([{re.escape(MARKS)}]*)")
#: The byte-level sign of each byte: its own character if that prints, else the next one from U+0100 on.
PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGNS = "".join(chr(b if b in PRINTS else 256 + b - sum(p < b for p in PRINTS)) for b in range(256))
#: Words of letters that the model gets as one sequence.
RUN = 16
#: Characters of texts, about, that are encoded at once: each distinct word in them is looked up once.
AT_ONCE = 1 << 20


def in_signs(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", SIGNS)[0]


def crosses(entry: str) -> bool:
    """Whether a vocabulary entry has letters beside a line break, or before a space."""
    if not set(entry) <= set(SIGNS):
        return False  # no text makes it
    text = bytes(map(SIGNS.index, entry)).decode(errors="replace")
    return ("\n" in text or " " in text[1:]) and any(c.isalpha() or c == "\ufffd" for c in text)


def at_once(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of about so many characters; a longer text is alone."""
    keys, texts, n = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n and n + len(text) > most:
                yield keys, texts
                keys, texts, n = [], [], 0
            keys.append(key)
            texts.append(text)
            n += len(text) + 1
    if texts:
        yield keys, texts


class Encoder:
    """ids of texts as the tokenizers library gives them; each distinct word is encoded once while it is remembered."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.most = Tokenizer.from_file(path), max_words
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab, model, space, line = self.library.get_vocab(with_added_tokens=False), self.library.model, in_signs(" "), in_signs("\n")
        # words of letters alone, which the pattern doesn't cut, stay apart in one sequence if no merge crosses the space or line break between them
        self.letters = None
        if line in vocab and not any((model.dropout, model.ignore_merges, model.continuing_subword_prefix, model.end_of_word_suffix)) and not any(map(crosses, vocab)):
            self.letters = Tokenizer(model)
            self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.spaced[[i for w, i in vocab.items() if w.startswith(space)]] = True
        self.opening = self.spaced.copy()
        self.opening[[i for w, i in vocab.items() if w == line]] = True
        self.words: dict[str, bytes] = {}  # of words with a space before them or, if they begin with it, a line break
        self.pieces: dict[str, bytes] = {}  # of pieces as they are
        self.line = self.plain(["\n"])[0]

    def plain(self, texts: list[str], by=None) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in (by or self.library).encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, some: list[str]) -> None:
        new = [p for p in set(some) if p not in self.pieces]
        self.pieces.update(zip(new, self.plain(new), strict=True))

    def learn(self, new: list[str]) -> None:
        """Encodes words many at a time, as one text, told apart by the spaces or line breaks before them."""
        words, pieces = self.words, self.pieces
        letters, others, starts, whole, tails = set(), set(), set(), [], []
        for w in new:
            if self.letters and (found := LETTERS.fullmatch(w)):
                if tail := found[1]:
                    whole.append(w)
                    tails.append(tail)
                    w = w[: -len(tail)]
                    if w in words:
                        continue
                letters.add(w)
                continue
            bare = w[1:] if w[:1] == "\n" else w
            b = bare.rstrip(MARKS)
            if len(b) < len(bare) and b[-1:] < "ɐ" and b[-1:].isalpha():
                whole.append(w)
                tails.append(bare[len(b) :])
                w = w[: -len(tails[-1])]
            if w not in words:
                (starts if w[:1] == "\n" else others).add(w)
        self.piece([*tails, *(w[1:] for w in starts)])
        words.update((w, self.line + pieces[w[1:]]) for w in starts)
        for some, of in ((list(letters), self.learn_letters), (list(others), self.learn_words)):
            for at in range(0, len(some), 2000):
                of(some[at : at + 2000])
        words.update((w, words[w[: -len(t)]] + pieces[t]) for w, t in zip(whole, tails, strict=True))

    def learn_letters(self, some: list[str]) -> None:
        opened = [w if w[0] == "\n" else " " + w for w in some]
        runs = "\n".join(in_signs("".join(opened[i : i + RUN])) for i in range(0, len(opened), RUN))
        self.keep(some, opened, self.plain([runs], self.letters)[0], self.opening)

    def learn_words(self, some: list[str]) -> None:
        self.keep(some, [" " + w for w in some], self.plain([" " + " ".join(some)])[0], self.spaced)

    def keep(self, some: list[str], opened: list[str], data: bytes, opens: np.ndarray) -> None:
        """Keeps the ids of words, which begin where an id opens one; if those are not as many, each word is encoded alone."""
        heads = np.flatnonzero(opens[np.frombuffer(data, "<u4")])
        if len(heads) == len(some):
            cuts = [*(heads * 4).tolist(), len(data)]
            self.words.update(zip(some, [data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        else:
            self.words.update(zip(some, self.plain(opened), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = self.words
        if len(words) + len(self.pieces) > self.most:
            words.clear()
            self.pieces.clear()
        if not texts:
            return []
        # each line begins with its break, the first one with one that is dropped below
        column, text = pa.array(texts, pa.large_string()), pa.large_string()
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", text), pc.replace_substring(column, "\n", " \n"), pa.scalar("", text)), " ")
        coded, begins = split.values.dictionary_encode(), split.offsets.to_numpy()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(words.get, distinct))
        at = [i for i, x in enumerate(ids) if x is None]
        # words that don't open as they should are never remembered, so they are all met here; a break alone may only come first
        wrong = [i for i in at if distinct[i] != "\n" and not OPENS.match(distinct[i])]
        lone = pc.index(coded.dictionary, pa.scalar("\n", text)).as_py()
        # a special string may hold cut points of its own
        special = [any(s in t for s in self.special) for t in texts]
        odd = np.array(special)
        if wrong or lone >= 0:
            ill = np.zeros(len(distinct), bool)
            ill[[*wrong, lone] if lone >= 0 else wrong] = True
            hits = ill[codes]
            hits[begins[:-1]] &= codes[begins[:-1]] != lone
            odd |= np.logical_or.reduceat(hits, begins[:-1])
        if at:
            if odd.any():
                needed = np.zeros(len(distinct), bool)
                needed[codes[np.repeat(~odd, np.diff(begins))]] = True
                for i in at:
                    ids[i] = b""
                at = [i for i in at if needed[i]]
            self.learn([distinct[i] for i in at])
            for i in at:
                ids[i] = words[distinct[i]]
        taken = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1)[begins] // 4
        flat = np.frombuffer(taken.buffers()[2], "<u4", ends[-1]) if ends[-1] else np.zeros(0, "<u4")
        skip = len(self.line) // 4
        got = [flat[i + skip : j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            some = [texts[i]] if special[i] else CUT.split(texts[i])
            self.piece(some)
            got[i] = np.frombuffer(b"".join(map(self.pieces.__getitem__, some)), "<u4")
        return got


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder: its words serve the next tasks too."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _encoders.setdefault(path, _encoders.get(path) or Encoder(path))


# --- Re-Pair ---------------------------------------------------------------------------------------------------------
def compress(ids: np.ndarray, starts: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts of documents in them, left, right, lengths) of ids below base. Rule k makes symbol base + k.

    Rounds go on until no pair occurs min_count times. In a round each place of a frequent pair is replaced unless a more
    frequent pair overlaps it; of a run of one symbol every second place counts. The most frequent pair is replaced
    everywhere, so every round makes a rule. A pair that is frequent in the next round was so before, or has a new symbol,
    so only such places are counted again.
    """
    n = len(ids)
    s = np.append(ids, 0).astype(np.int32)  # symbols number less than ids and base together
    # symbols that are gone stay in place; the others are chained
    after, before, gone = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.zeros(n + 1, bool)
    opens = np.ones(n + 1, bool)  # no pair begins at the last symbol of a document
    ends = np.append(starts[1:], n) - 1
    opens[ends[ends >= starts]] = False
    opens[n - 1 :] = False
    left, right, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.ones(base, np.int64)]
    n_symbols, at, touched = base, np.flatnonzero(opens), np.zeros(n + 1, bool)
    while len(at):
        follow = after[at]
        x, y = s[at], s[follow]
        odd, bits = odd_of_runs(at, follow, x == y), n_symbols.bit_length()
        pairs = x.astype(np.int64) << bits | y
        touched[:] = False
        if odd is not None:
            touched[at[odd]] = True
            pairs[odd] = -1
        some, counts, held, found = frequent(pairs, 2 * bits, min_count)
        if not len(some):
            break
        at, follow = at[held], follow[held]
        rank = np.empty(len(some), np.int32)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(some))
        mine = rank[found]
        apart, more = follow[:-1] != at[1:], mine[1:] > mine[:-1]
        wins = np.ones(len(at), bool)
        wins[1:] = apart | more
        wins[:-1] &= apart | ~more
        # pairs that keep too few places wait for a later round
        first = np.flatnonzero(wins)
        which = found[first]
        number = np.bincount(which, minlength=len(some)) >= min_count
        enough = np.flatnonzero(number[which])
        first, which = first[enough], which[enough]
        won, second = at[first], follow[first]
        s[won] = n_symbols + (np.cumsum(number) - 1)[which]
        opens[won] = opens[second]
        opens[second], gone[second] = False, True
        third = after[second]
        after[won], before[third] = third, won
        touched[at] = True
        touched[before[won]] = True  # of the first symbol: the spare place at the end
        at = np.flatnonzero(touched & opens)
        a, b = some[number] >> bits, some[number] & (1 << bits) - 1
        so_far = np.concatenate(lengths)
        left.append(a)
        right.append(b)
        lengths.append(so_far[a] + so_far[b])
        n_symbols += len(a)
    s = s[:n][~gone[:n]]
    sizes = np.concatenate(lengths)
    # documents begin where the expansion reaches their first id
    where = np.append(0, np.cumsum(sizes[s]))
    return s, np.searchsorted(where, starts), np.concatenate(left), np.concatenate(right), sizes[base:]


def odd_of_runs(at: np.ndarray, follow: np.ndarray, equal: np.ndarray) -> np.ndarray | None:
    """Which places of pairs of one symbol are the second, fourth, ... of a run of such places."""
    i = np.flatnonzero(equal)
    if not len(i):
        return None
    odd, n = np.zeros(len(at), bool), np.arange(len(i))
    head = np.append(True, follow[i[:-1]] != at[i[1:]])
    odd[i] = (n - np.maximum.accumulate(np.where(head, n, 0))) % 2 == 1
    return odd


def frequent(pairs: np.ndarray, bits: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that occur min_count times in order, their counts, where they are, which of them each of those is) of pairs of so many bits; -1 is none."""
    n = len(pairs)
    place_bits = n.bit_length()
    if bits + place_bits < 64:  # a sort of pairs with their places is faster than one of places by pair
        order = pairs << place_bits
        order |= np.arange(n)
        order.sort()
        places = order & (1 << place_bits) - 1
        order >>= place_bits
    else:
        places = np.argsort(pairs, kind="stable")
        order = pairs[places]
    heads = np.flatnonzero(np.append(True, order[1:] != order[:-1])[:n])
    counts = np.diff(np.append(heads, n))
    many = (counts >= min_count) & (order[heads] >= 0)
    found = np.empty(n, np.int32)
    found[places] = np.repeat(np.where(many, np.cumsum(many, dtype=np.int32) - 1, -1).astype(np.int32), counts)
    held = np.flatnonzero(found >= 0)
    return order[heads[many]], counts[many], held, found[held]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids of a run of symbols."""
    s = symbols.astype(np.int64)
    while (big := s >= base).any():
        at = np.flatnonzero(big)
        rule = s[at] - base
        grown = np.repeat(s, 1 + big)
        to = at + np.arange(len(at))
        grown[to], grown[to + 1] = left[rule], right[rule]
        s = grown
    return s.astype("<u4")


def expand_all(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The same for a whole shard: each rule is expanded once, and symbols copy from that."""
    flat = np.concatenate([np.arange(base, dtype="<u4"), expand(np.arange(base, base + len(left)), left, right, base)])
    sizes = np.concatenate([np.ones(base, np.int64), lengths])
    begins = np.cumsum(sizes) - sizes
    n = sizes[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(begins[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def stretch(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, base: int, start: int, n: int) -> np.ndarray:
    """ids start to start + n of a document's symbols, expanding only the symbols that hold them."""
    sizes = np.where(symbols < base, 1, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1)
    ends = np.cumsum(sizes)
    first, stop = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left") + 1
    begins = ends[first] - sizes[first] if first < len(ends) else start
    return expand(symbols[first:stop], left, right, base)[start - begins : start - begins + n]


# --- files -----------------------------------------------------------------------------------------------------------
def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Writes shards of all rows in order of id to `out` (Parquet, SHARD_SCHEMA).

    Null texts count as empty; null ids come first; repeated ids stay, in order of their texts' hashes, and may lie in
    several ranges; a very long text makes a shard of its own. Columns of other names are ignored; an empty table gives no
    shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, docs_, ids, total, before, part = encoder_for(path), [], [], 0, 0, TaskContext.get().partitionId()
        base = max(encoder.library.get_vocab_size(), end_id + 1)

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], np.int64)
            symbols, at, left, right, sizes = compress(np.concatenate(ids), np.cumsum(lengths) - lengths, base)
            width, known = 2 if base + len(left) <= 1 << 16 else 4, [d for d in docs_ if d is not None]
            row = [part, before, total, min(known, default=None), max(known, default=None), np.array([d or 0 for d in docs_], "<i8").tobytes(), np.array([d is None for d in docs_]).tobytes(), at.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), symbols.astype(f"<u{width}").tobytes(), width, left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), sizes.astype("<i8").tobytes(), base]
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            names, types = zip(*(x.split() for x in SHARD_SCHEMA.split(", ")), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(row, types, strict=True)], names=names)

        for keys, texts in at_once(batches):
            for key, got in zip(keys, encoder.encode(texts), strict=True):
                if total and total + len(got) + 1 > shard_ids:
                    yield shard()
                    docs_, ids, total, before = [], [], 0, before + total
                docs_.append(key)
                ids.append(np.append(got, np.uint32(end_id)))
                total += len(got) + 1
        if total:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // part_bytes))
    # rows of one id lie in the order of a hash and, if they are the same, in any
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("nth")]
    keyed = rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("nth"))
    map_batches(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text"), run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(out)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, if wanted, the ids (little-endian, four bytes each) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("left", "right"))
                ids = expand_all(np.frombuffer(row["symbols"], f"<u{row['width']}"), left, right, np.frombuffer(row["lengths"], "<i8"), row["base"])
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                if len(ids) != ends[-1] or ends[-1] != row["n_ids"]:
                    raise ValueError(f"damaged shard after {row['ids_before']} ids of range {row['part']}")
                keys, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], "?")
                own = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(keys, mask=nulls), pa.array([row["part"]] * len(keys), pa.int32()), pa.array(row["ids_before"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.tobytes() for x in own], pa.binary())] if with_ids else []), names=["doc_id", "part", "own_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    files = token_files(spark, path)
    docs = map_batches(files, run, "doc_id long, part int, own_start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # one row for each range of the writer's exchange
    parts = files.groupBy("part").agg(F.max(F.col("ids_before") + F.col("n_ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = docs.join(F.broadcast(parts), F.col("part") == F.col("p"))
    return joined.select("doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_stretch(spark: SparkSession, path: str, doc_id: int, start: int, n: int) -> DataFrame:
    """(doc_id, ids) of up to n ids from `start` on of each document with that id: only its shards are read, and only the symbols that hold the stretch are expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], "?")
                symbols, at = np.frombuffer(row["symbols"], f"<u{row['width']}"), np.append(np.frombuffer(row["doc_symbols"], "<i8"), len(row["symbols"]) // row["width"])
                left, right = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("left", "right"))
                own = [stretch(symbols[at[i] : at[i + 1]], left, right, np.frombuffer(row["lengths"], "<i8"), row["base"], start, n) for i in np.flatnonzero((keys == doc_id) & ~nulls)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(own), pa.int64()), pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    held = token_files(spark, path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return map_batches(held, run, "doc_id long, ids array<long>")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), out, model_path(MODEL))
    return read_token_files(spark, out)
