"""Byte-level BPE by a sentencepiece BPE model that is serialised directly from a rank file.

Every byte is mapped to one printable character, every rank becomes a piece scored by
minus its rank, and normalisation is the identity: sentencepiece then merges exactly as
the ranks say. Texts are cut into pre-tokens by the pattern and each pre-token is encoded
on its own (a pre-token that is itself a rank is that one id, as byte-level BPE libraries do).

Defined results: a null text counts as empty; an empty text has no ids and decodes to no
bytes; texts of any length are encoded whole; repeated rows and ties are rows like any
other; an empty table gives an empty table; other columns pass through unless they bear
the name of the output column, which replaces them.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import parts, small_batches

#: Distinct pre-tokens whose ids a task remembers, of at most ``SHORT`` characters each; beyond it the memory starts afresh (speed only).
REMEMBERED, SHORT = 100_000, 64


def byte_characters() -> list[str]:
    """One printable character for each byte: itself if printable Latin-1, else one past 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in rank order; ranks must be 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model; piece 0 is the unknown piece that the format requires."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        m.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank))
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(m.pieces)
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = False
    return m.SerializeToString()


class Codec(dict):
    """Encodes whole texts to packed little-endian unsigned 32-bit ids, and back to bytes.

    As a dictionary it remembers the packed ids of pre-tokens. Nothing in it refers back to it, so a task's codec goes when the task ends.
    """

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        chars = byte_characters()
        self.to_chars = dict(enumerate(chars))
        to_byte = {c: b for b, c in enumerate(chars)}
        n = self.sp.get_piece_size()
        self.bytes_of = [bytes(to_byte[c] for c in self.sp.id_to_piece(i)) for i in range(1, n)]
        self.whole = {t: i for i, t in enumerate(self.bytes_of)}

    def __missing__(self, token: str) -> bytes:
        ids = self.pre_token(token)
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = ids
        return ids

    def pre_token(self, token: str) -> bytes:
        raw = token.encode("utf-8")
        if (i := self.whole.get(raw)) is not None:
            return i.to_bytes(4, "little")
        ids = self.sp.encode(raw.decode("latin-1").translate(self.to_chars))
        return b"".join((i - 1).to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def encode_decode(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Adds ``out``: struct(n_tokens, ids = packed little-endian u32, decoded = the ids' bytes).

    ``ranks`` is the path of a rank file on the driver; its model (under 1 MB for 50,000
    ranks, fixed by the vocabulary) is what the closure carries.
    """
    model = serialise(read_ranks(ranks))
    kind = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    @F.arrow_udf("n_tokens long, ids binary, decoded binary")
    def codec(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = Codec(model, pattern)
        for batch in parts(texts):
            ids = [c.encode(x.as_py() or "") for x in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())],
                fields=list(kind),
            )

    return small_batches(df).withColumn(out, codec(F.col(text)))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the multilingual 50k ranks, and the decoded bytes, as digests."""
    import public_tokenizers as vocab

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_decode(docs, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
    return done.select("doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised corpus: doc_id, lang, source, n_tokens and packed ids of every document; ids that do not decode to the text fail the run."""
    import public_tokenizers as vocab

    done = encode_decode(docs.select("doc_id", "lang", "source", "text"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN, out="__bpe")
    same = F.decode("__bpe.decoded", "utf-8") == F.coalesce("text", F.lit(""))
    ids = F.when(same, F.col("__bpe.ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")))
    return done.select("doc_id", "lang", "source", F.col("__bpe.n_tokens").alias("n_tokens"), ids.alias("ids"))
