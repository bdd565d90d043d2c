"""SentencePiece encoding and decoding by a forward pass that words with a common prefix share.

A text gets its leading mark, blanks become marks, and it falls into marked words.  The distinct words of a batch that
are not known yet are sorted, which lays them out as a depth-first walk of their trie: a word keeps the forward states
of the prefix it shares with the word before it and computes only the rest.

For a unigram model the state of a prefix is its best score and last piece (Viterbi).  The best path by score is not
what a byte-pair model yields, whose merges go by rank; there the state is the last piece of the prefix's own encoding.
It is the one piece that follows the encoding of the prefix before it compatibly, that is, the two alone encode to
themselves; such chains are exactly the encodings.  Either way the result is the library's.  Characters without a piece
fall back to bytes.  Pieces and scores come from a model file; nothing is trained.

Null text: null.  Empty text: no pieces.  Repeated rows: each is encoded.  Empty table: empty result.  U+2581 in a text
decodes to a blank, as in the library.  Other columns of the input are left alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, give_back, shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of a generation's words, and twice the pairs of pieces, that a worker remembers.
KNOWN = 1_000_000
RADIX = 1 << 22
#: Prefixes of at most so many characters keep their ids; those of a longer word are gathered from its end.
SHARED = 64


class Pieces:
    def __init__(self, ids: dict[str, int], scores: dict[str, float], bytes_: dict[int, int], unigram: bool = False, unknown: int = 0, even: Callable[[str], str] = str):
        """ids and scores of the ordinary pieces; ids of the bytes (none: characters without a piece are unknown); even rewrites a text first."""
        self.even = even
        self.ids, self.scores, self.bytes, self.unigram, self.unknown = ids, scores, bytes_, unigram, unknown
        #: pieces by number, the ids that each is written as, and the characters without a piece that were met
        self.numbers, self.names, self.codes, self.odd = {"": 0}, [""], [b""], set()
        for p in sorted(ids):
            self.number(p)
        self.goto, self.fail, self.ends = self.automaton()
        self.least = min(scores.values(), default=0.0) - 10.0
        #: words of this generation and of the one before it; what is not met again in a generation is forgotten
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        #: known words that do not decode to themselves
        self.lossy: set[str] = set()
        self.pairs: dict[int, bool] = {}
        # characters that no longer piece holds never join a neighbour
        held = set(chain.from_iterable(p for p in ids if len(p) > 1))
        alone = "".join(c for c in "\n\t\r" if c not in held)
        self.split = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        if any(MARK in p.lstrip(MARK) for p in ids):  # pieces of several words: a text is one word
            self.split = re.compile(r"[\s\S]+")

    @classmethod
    def load(cls, path: str) -> Pieces:
        """A model file of either kind; what it rewrites in texts beforehand is left to the library's normaliser."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kind = spec.trainer_spec.ModelType.Name(spec.trainer_spec.model_type)
        if kind not in ("UNIGRAM", "BPE"):
            raise ValueError(f"pieces of kind {kind} are not supported")
        if not spec.normalizer_spec.add_dummy_prefix or not spec.normalizer_spec.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark the beginnings of words are supported")
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        plain = [i for i in n if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        found = {m.id_to_piece(i): i for i in plain}
        as_it_is = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces
        even = str if as_it_is else lambda t: m.normalize(t).removeprefix(MARK).replace(MARK, " ")
        return cls(found, {p: m.get_score(i) for p, i in found.items()}, {int(m.id_to_piece(i)[3:5], 16): i for i in n if m.is_byte(i)}, kind == "UNIGRAM", m.unk_id(), even)

    def number(self, piece: str) -> int:
        """Own number of a piece; characters without a piece get one when they are met."""
        if (p := self.numbers.get(piece)) is None:
            p = self.numbers[piece] = len(self.names)
            self.names.append(piece)
            self.codes.append(array("i", self.of(piece)).tobytes())
            if piece not in self.ids:
                self.odd.add(piece)
        return p

    def automaton(self) -> tuple[dict[int, int], list[int], list[tuple[tuple[int, int], ...]]]:
        """All pieces as an automaton over characters.

        The next node by node and character; the node of a node's longest proper suffix; and the pieces that end at a
        node as (length, number), the longest first.
        """
        goto, fail, ends, made = {}, [0], [()], []
        for p, n in self.numbers.items():
            node = 0
            for depth, ch in enumerate(p):
                key = node << 21 | ord(ch)
                if (to := goto.get(key)) is None:
                    to = goto[key] = len(fail)
                    fail.append(0)
                    ends.append(())
                    made.append((depth, node, ord(ch), to))
                node = to
            if p:
                ends[node] = ((len(p), n),)
        for depth, parent, code, node in sorted(made):
            if depth:
                at = fail[parent]
                while (to := goto.get(at << 21 | code)) is None and at:
                    at = fail[at]
                fail[node] = to or 0
            ends[node] += ends[fail[node]]
        return goto, fail, ends

    def compatible(self, key: int) -> bool:
        """Whether two pieces, the first possibly empty, encode to themselves."""
        a, b = map(self.names.__getitem__, divmod(key, RADIX))
        if len(self.pairs) > KNOWN // 2:
            self.pairs.clear()
        # two pieces that join into a piece would have joined
        found = self.pairs[key] = not (a and a + b in self.scores) and self.merge(a + b) == ([a, b] if a else [b])
        return found

    def best(self, i: int, ends: tuple[tuple[int, int], ...], scores: list[np.float32]) -> tuple[int, int]:
        """Viterbi: length and number of the last piece of the best path to a prefix of i characters, of those that end there; of equal scores, summed in single precision as by the library, the longest."""
        score, piece = None, (0, 0)
        for n, p in ends:
            x = scores[i - n] + np.float32(self.scores.get(self.names[p], self.least))
            if score is None or x > score:
                score, piece = x, (n, p)
        scores.append(score)
        return piece

    def learn(self, words: set[str]) -> None:
        """Encode new words, as a depth-first walk of their trie; a state is the number of the last piece, and short prefixes keep their ids."""
        self.held += sum(map(len, words))
        for c in set(chain.from_iterable(words)) - self.numbers.keys():
            self.number(c)
        pairs, numbers, names, written, odd = self.pairs, self.numbers, self.names, self.codes, self.odd
        goto, fail, ends = self.goto, self.fail, self.ends
        before, states, nodes, codes, scores = "", [0], [0], [b""], [np.float32(0)]
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del states[same + 1 :], nodes[same + 1 :], codes[same + 1 :], scores[same + 1 :]
            node = nodes[-1]
            for i in range(same, len(word)):
                code = ord(word[i])
                while (to := goto.get(node << 21 | code)) is None and node:
                    node = fail[node]
                node = to or 0
                nodes.append(node)
                found = ends[node]
                if not found or found[-1][0] > 1:  # the character is no piece itself
                    found = (*found, (1, numbers[word[i]]))
                if self.unigram:
                    n, p = self.best(i + 1, found, scores)
                else:
                    for n, p in found:
                        key = states[i + 1 - n] * RADIX + p
                        if (good := pairs.get(key)) is None:
                            good = self.compatible(key)
                        if good:
                            break
                    else:  # only where scores tie
                        p = self.merge(word[: i + 1])[-1]
                        n, p = len(p), numbers[p]
                states.append(p)
                if i < SHARED:
                    codes.append(codes[i + 1 - n] + written[p])
            before, at, rest = word, len(word), []
            while at > SHARED:
                rest.append(written[states[at]])
                at -= len(names[states[at]])
            ids = codes[at] + b"".join(reversed(rest))
            if odd and not odd.isdisjoint(word):
                ids = array("i", ids)
                if not self.bytes:  # a run of unknown characters is one unknown piece
                    ids = array("i", [x for n, x in enumerate(ids) if x != self.unknown or not n or ids[n - 1] != x])
                if b"".join(map(self.written.__getitem__, ids)) != word.replace(MARK, " ").encode("utf-8", "surrogatepass"):
                    self.lossy.add(word)
                ids = ids.tobytes()
            self.known[word] = ids

    def merge(self, word: str) -> list[str]:
        """Byte-pair encoding by its definition: join the adjacent pair of the best score, the leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def of(self, piece: str) -> tuple[int, ...]:
        if (i := self.ids.get(piece)) is not None:
            return (i,)
        return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they decode to it: decoding joins what the words decode to."""
        split = [self.split.findall(MARK + self.even(t).replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)) - self.known.keys()
        if new:
            if self.held > KNOWN:
                self.older, self.known, self.held = self.known, {}, 0
                new = set(chain.from_iterable(split))
            for w in new & self.older.keys():
                self.known[w] = self.older[w]
                self.held += len(w)
            self.learn(new - self.older.keys())
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]
        same = [self.even is str and (not self.lossy or self.lossy.isdisjoint(words)) for words in split]
        return ids, same

    @property
    def written(self) -> list[bytes]:
        """By id, the bytes that a piece stands for."""
        if not hasattr(self, "_written"):
            self._written = [b""] * (max([*self.ids.values(), *self.bytes.values(), self.unknown]) + 1)
            for p, i in self.ids.items():
                self._written[i] = p.replace(MARK, " ").encode()
            for b, i in self.bytes.items():
                self._written[i] = bytes([b])
            self._written[self.unknown] = self._written[self.unknown] or " ⁇ ".encode()
        return self._written

    def decode(self, ids) -> str:
        """The text: leading mark dropped, broken byte runs replaced."""
        return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def loaded(path: str) -> Pieces:
    return shared(("pieces", path), lambda: Pieces.load(path))


#: Texts that are encoded together.
GROUP = 500


def encoded(text: Column, path: str = MODEL) -> Column:
    """A struct: ids (array of int) and round_trip (they decode to the text)."""

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def encode(column: pa.Array) -> pa.Array:
        give_back()  # what the batch before has left
        model, ids, ends, same = loaded(path), bytearray(), [0], []
        for at in range(0, len(column), GROUP):
            texts = column.slice(at, GROUP).to_pylist()
            found, good = model.encode(texts)
            ids += np.concatenate(found).tobytes()
            ends += (ends[-1] + np.cumsum([len(x) for x in found])).tolist()
            if model.even is not str:  # the model rewrites texts first
                good = [t is None or model.decode(x.tolist()) == t.replace(MARK, " ") for t, x in zip(texts, found, strict=True)]
            same += [None if t is None else g for t, g in zip(texts, good, strict=True)]
        null = pa.array([x is None for x in same], pa.bool_())
        flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=null)
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return encode(text)


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of ids; null stays null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        model = loaded(path)
        return pa.array([None if x.as_py() is None else model.decode(x.as_py()) for x in column], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: one row for each row of docs."""
    found = docs.select(col(id_col).alias("doc_id"), encoded(col(text_col), path).alias("e"))
    n = F.when(F.col("e.ids").isNotNull(), F.size("e.ids")).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), "e.ids", "e.round_trip")
