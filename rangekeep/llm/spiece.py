"""SentencePiece encoding and decoding with the tokenizers library.

The model file is a protobuf; it is parsed here field by field.  From it come the normaliser (dummy prefix,
extra white space, the white-space marker), the pieces with their scores, and byte fallback.  A unigram
model keeps its scores; in a BPE model a piece's score is the rank of the merges that make it.  The distinct
new words of each batch are encoded by the library, which decodes their ids too; where a model's words are not decoded apart from each other,
it decodes the ids of whole texts, as decode() always does.  Parity with the sentencepiece library is verified at
run time for every text: by its words, each once for as long as its ids are kept, where the text's ids are those of its words in turn;
else on the whole text.  Ids that differ end the job.

Null or empty texts have no ids.  Repeated rows get equal ids.  Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields

MODEL = os.environ.get("RANGEKEEP_SPIECE", "/opt/tokenizers/piece_bpe_32k.model")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, type), and the trainer's and normaliser's settings, with their defaults."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "suffix": False, "unk": 0, "charsmap": b"",
             "dummy_prefix": True, "squeeze": True, "escape": True}
    trainer = {3: "type", 35: "byte_fallback", 24: "suffix", 40: "unk"}
    normaliser = {2: "charsmap", 3: "dummy_prefix", 4: "squeeze", 5: "escape"}
    for field, value in wire(data):
        if field == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(wire(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif field in (2, 3):
            names = trainer if field == 2 else normaliser
            model |= {names[k]: v for k, v in wire(value) if k in names}
    return model


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs of pieces that make a piece, best score first."""
    rank = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = [(-score, rank[p], rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for p, score, kind in pieces
             if kind == NORMAL for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [x[4:] for x in sorted(found)]


def build(model: dict):
    """A tokenizers.Tokenizer of the model and its decoder.  Its input is normalised text."""
    from tokenizers import Tokenizer, decoders, models

    if model["suffix"] or not model["escape"]:
        raise ValueError("white space as a suffix, or unescaped, is not supported")
    pieces = model["pieces"]
    if model["type"] == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], model["unk"], bool(model["byte_fallback"])))
    elif model["type"] == BPE:
        tok = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges(pieces), cache_capacity=0,
                                   unk_token=pieces[model["unk"]][0], fuse_unk=True,
                                   byte_fallback=bool(model["byte_fallback"])))
    else:
        raise ValueError(f"model type {model['type']} is not supported")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])
    return tok


def normaliser(model: dict):
    """Text to what the pieces are matched against: the character map, squeezed spaces, dummy prefix, marker."""
    from tokenizers import normalizers

    mapped = normalizers.Precompiled(model["charsmap"]).normalize_str if model["charsmap"] else None
    prefix = MARK if model["dummy_prefix"] else ""

    def normalise(text: str) -> str:
        text = mapped(text) if mapped else text
        text = re.sub(" {2,}", " ", text.strip(" ")) if model["squeeze"] else text
        return prefix + text.replace(" ", MARK) if text else ""

    return normalise


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """Encoder and decoder of one model.  Where no piece spans the start of a word, the ids of a text are
    those of its words in turn, so each batch sends its new distinct words to the library, and ids of words
    are kept, up to CACHE of them; then those that came in one batch alone go, or all if that is not half of them."""

    CACHE = 250_000
    WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = parse_model(data)
        self.fast = build(self.model)
        self.normalise = normaliser(self.model)
        self.slow = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = self.model["pieces"]
        self.by_word = not any(a != MARK and b == MARK for p, _, _ in pieces for a, b in zip(p, p[1:]))
        self.plain = self.by_word and self.model["dummy_prefix"] and not self.model["charsmap"]
        # each word begins with a piece that has the marker, so it is decoded alike alone and within a text
        self.apart = self.plain and any(p == MARK and kind in (NORMAL, USER) for p, _, kind in pieces)
        self.known: dict[str, bytes] = {}
        self.backs: dict[str, str] = {}
        self.odd: set[str] = set()
        #: words that came again in a later batch since words were last let go
        self.again: set[str] = set()

    def split(self, text: str) -> list[str]:
        """The words of a text after normalising; the marker of one single space is left out."""
        if self.plain and text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return self.WORD.findall(self.normalise(text))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, all of them verified."""
        return self.by_words(texts)[0] if self.by_word else self.verified(texts, list(map(packed, self.ids_of([self.normalise(t) for t in texts]))))

    def round_trip(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """encode_bytes()'s ids and what they are decoded to.  Where the decoder takes words apart from each other, each kept word is
        decoded by the library once, and a text is its words with the spaces between them."""
        if not self.apart:
            ids = self.encode_bytes(texts)
            return ids, self.decode([np.frombuffer(x, "<i4").tolist() for x in ids])
        ids, split = self.by_words(texts)
        return ids, [" ".join(map(self.backs.__getitem__, ws)) for ws in split]

    def ids_of(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.fast.encode_batch_fast(parts, add_special_tokens=False)]

    def by_words(self, texts: list[str]) -> tuple[list[bytes], list[list[str]]]:
        """encode_bytes()'s ids by the ids of words, and the words of each text."""
        split = [self.split(t) for t in texts]
        used = set().union(*split)
        new = list(used - self.known.keys())
        self.again |= used & self.known.keys()
        if len(self.known) + len(new) > self.CACHE:
            stay = self.again if len(self.again) + len(new) <= self.CACHE // 2 else ()
            self.known, self.backs = ({w: kept[w] for w in stay if w in kept} for kept in (self.known, self.backs))
            self.odd, self.again = self.odd.intersection(stay), used.intersection(stay)
            new = list(used - self.known.keys())
        # words without the marker at their start come from split()'s short way, or begin an unprefixed text
        mark = MARK if self.plain else ""
        made = self.ids_of([w if w.startswith(MARK) else mark + w for w in new])
        self.known.update(zip(new, map(packed, made), strict=True))
        if self.apart:
            self.backs.update((w, w if b == w else b) for w, b in zip(new, self.decode(made), strict=True))
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        if not self.plain:
            return self.verified(texts, out), split
        # a word as sentencepiece would read it alone; others, with more or fewer markers, stand in texts that are verified whole
        alone = {w: w.removeprefix(MARK) for w in new}
        alone = {w: x for w, x in alone.items() if x and MARK not in x}
        self.verified(list(alone.values()), [self.known[w] for w in alone])
        self.odd.update(w for w in new if w == MARK or MARK in w[1:])
        whole = [i for i, ws in enumerate(split) if not self.odd.isdisjoint(ws)] if self.odd else []
        self.verified([texts[i] for i in whole], [out[i] for i in whole])
        return out, split

    def verified(self, texts: list[str], found: list[bytes]) -> list[bytes]:
        """found, if sentencepiece gives the same ids for the texts."""
        for t, p, ids in zip(texts, found, self.slow.encode(texts, num_threads=1) if texts else [], strict=True):
            if packed(ids) != p:
                raise ValueError(f"the libraries differ on a text of {len(t)} characters, sha256 {hashlib.sha256(t.encode()).hexdigest()}")
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_bytes(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Pieces' bytes in a row, less the dummy prefix; broken byte sequences become U+FFFD."""
        return self.fast.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """One codec for each model and Python worker: tasks of a worker share the ids of words."""
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core; threads would take those of others
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]


SCHEMA = fields("n_tokens long,ids_sha256 string,n_bytes long,decoded_sha256 string,round_trip boolean")
#: Texts a call to the library: bounds what a task holds.
BATCH = 256


def tokenise(text: Column, model_path: str = MODEL, with_ids: bool = False) -> Column:
    """A struct of the number of ids, their digest (little-endian 32-bit integers), the text's UTF-8 length,
    the decoded text's digest, and whether decoding gave the text back.  with_ids: the ids as well."""
    with open(model_path, "rb") as f:
        model = f.read()
    schema = fields(",".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in SCHEMA)
                    + (",ids array<int>" if with_ids else ""))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(model)
        for column in batches:
            rows, kept = [], []
            for at in range(0, len(column), BATCH):
                texts = [t or "" for t in column.slice(at, BATCH).to_pylist()]
                packed, backs = codec.round_trip(texts)
                kept += packed if with_ids else []
                for t, p, back in zip(texts, packed, backs, strict=True):
                    raw = t.encode()
                    rows.append((len(p) // 4, hashlib.sha256(p).hexdigest(), len(raw), hashlib.sha256(back.encode()).hexdigest(), back == t))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            if with_ids:  # ids stay packed: as Python numbers those of a batch would take hundreds of megabytes
                ends = np.cumsum([0, *(len(p) // 4 for p in kept)], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
            yield pa.StructArray.from_arrays(arrays, names=schema.names)

    return F.arrow_udf(run, schema).asNondeterministic()(text)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL,
           with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: the id and tokenise()'s fields."""
    made = docs.select(F.col(id_col).alias("doc_id"), tokenise(F.col(text_col), model_path, with_ids).alias("t"))
    return made.select("doc_id", "t.*")


def decode(tokens: DataFrame, ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """tokens with a column `text` that its ids decode to (null ids: null)."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(model)
        for column in batches:
            texts: list[str | None] = []
            for at in range(0, len(column), BATCH):
                ids = column.slice(at, BATCH).to_pylist()
                texts += [None if i is None else t for i, t in zip(ids, codec.decode([i or [] for i in ids]), strict=True)]
            yield pa.array(texts, pa.string())

    return tokens.withColumn("text", F.arrow_udf(run, "string")(F.col(ids_col)))
