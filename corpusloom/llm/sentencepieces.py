"""SentencePiece encoding of merge-type (BPE) vocabularies with a score-ordered agenda of adjacent symbol pairs.

Text never leaves its row: one narrow pass in Arrow batches, no shuffle. A text is cut into stretches that no
vocabulary piece can bridge (which is verified against the vocabulary itself when it is loaded), each new stretch
is merged by the agenda and compared with the sentencepiece library, and known stretches come from a bounded cache.

Defined results: null and empty texts give the end id only and decode to ""; text that no piece covers falls
back to byte pieces, or to the unknown id where the vocabulary has none. Where the agenda and the library differ, the
library's ids stand and the row is marked as corrected. Rows keep their order and number; extra columns stay, those
named like results are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, remembered, table

SPACE = "▁"
#: Stretches in each of the two generations that a Python worker keeps; only speed depends on it.
CACHE = 250_000
#: Stretches of texts whose new ones are compared with the library at once.
AT_ONCE = 200_000
#: Symbols up to which the agenda is a plain list.
SHORT, NEVER = 40, float("inf")
#: A stretch: optional spaces, then letters, or marks, or one digit, or one blank.
FINE = re.compile(f"{SPACE}*(?:[^\\W\\d_²]+|(?:[^\\w{SPACE}\\s]|[_\r²])+|\\d|\\s)|{SPACE}+")
COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
WHOLE = re.compile("(?s).+")


class MergeEncoder:
    """Encodes with the pieces of a sentencepiece model of merge type and identity normalization."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb

            proto = pb.ModelProto()
        except ImportError as e:
            raise RuntimeError("reading a vocabulary needs sentencepiece's protobuf module") from e
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the vocabulary isn't of merge type")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only identity normalization is supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.ids, self.costs, self.bytes, self.unknown = {}, {}, {}, proto.trainer_spec.unk_id
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.costs[p.piece] = i, -p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            elif p.type == kinds.USER_DEFINED:
                raise ValueError("user-defined pieces aren't supported")
        self.end = self.library.eos_id()
        self.cut = next(c for c in (FINE, COARSE, WHOLE) if all(c.fullmatch(x) and c.match(x).end() == len(x) for x in self.ids))
        self.names = [str(i) for i in range(len(proto.pieces))]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.corrected: set[str] = set()

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of one stretch: the best-scored adjacent pair merges first, the leftmost among equals."""
        symbols = self._short(list(text)) if len(text) <= SHORT else self._long(list(text))
        out: list[int] = []
        for s in symbols:
            if (x := self.ids.get(s)) is not None:
                out.append(x)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda as a plain list beside the symbols: costs[i] is that of joining symbols i and i + 1."""
        cost = self.costs.get
        costs = [cost(a + b, NEVER) for a, b in itertools.pairwise(symbols)]
        while costs and (best := min(costs)) < NEVER:
            i = costs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                costs[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _long(self, symbols: list[str | None]) -> list[str]:
        """The agenda as a heap over a linked list of symbols; stale entries are skipped."""
        n, costs = len(symbols), self.costs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(costs[pair], i, i + 1, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in costs]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in costs:
                    heapq.heappush(agenda, (costs[new], i, k, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in costs:
                heapq.heappush(agenda, (costs[new], h, i, new))
        return [s for s in symbols if s is not None]

    def _learn(self, new: list[str]) -> None:
        """Merges new stretches and keeps the agenda's ids; where the library's differ, the library's stand and the stretch is
        marked. The dummy prefix of the library is taken off again."""
        if self.prefix:
            lone = [x for x in new if x == SPACE or not x.startswith(SPACE)]
            headed = [x for x in new if x != SPACE and x.startswith(SPACE)]
            theirs = dict(zip(headed, self.library.encode([x[1:] for x in headed], num_threads=1), strict=True)) if headed else {}
            # A line feed is never part of a merge with text, so ids after it are those of the stretch alone.
            if lone:
                head = len(self.library.encode("\n"))
                theirs |= {k: v[head:] for k, v in zip(lone, self.library.encode(["\n" + x for x in lone], num_threads=1), strict=True)}
        else:
            theirs = dict(zip(new, self.library.encode(new, num_threads=1), strict=True)) if new else {}
        for k, v in theirs.items():
            own = self.known[k] = self.merge(k)
            if own != (v := tuple(v)):
                self.known[k] = v
                self.corrected.add(k)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[list[int], str, bool]]:
        """Ids of each text with the end id, their decimal form joined by spaces, and whether the library corrected them."""
        cut, names, out = self.cut.findall, self.names, []
        at = 0
        while at < len(texts):
            if len(self.known) > CACHE:  # what is used again comes over from the older generation
                self.known, self.older = {}, self.known
                self.corrected.intersection_update(self.older)
            known, older = self.known, self.older
            cuts, new, stop, held = [], {}, at, 0
            while stop < len(texts) and (stop == at or held < AT_ONCE):  # a stretch of texts whose new stretches are learnt at once
                text = texts[stop]
                parts = cut(self.prefix + text.replace(" ", SPACE)) if text else []
                for x in set(parts).difference(known):
                    if (ids := older.get(x)) is None:
                        new[x] = None
                    else:
                        known[x] = ids
                cuts.append(parts)
                held += len(parts)
                stop += 1
            gc.disable()  # nothing here is cyclic, and walking the stretches that are kept takes time
            try:
                self._learn(list(new))
            finally:
                gc.enable()
            for parts in cuts:
                ids = [*itertools.chain.from_iterable(map(known.__getitem__, parts)), self.end]
                out.append((ids, " ".join(map(names.__getitem__, ids)), bool(self.corrected) and not self.corrected.isdisjoint(parts)))
            at = stop
        whole = min((i for i, t in enumerate(texts) if t), key=lambda i: (-min(len(texts[i]), 2000), i), default=None)
        if whole is not None and self.library.encode(texts[whole], add_eos=True) != out[whole][0]:
            # cutting isn't sound for this vocabulary after all: the library's ids stand for the batch
            theirs = self.library.encode([t or "" for t in texts], add_eos=True, num_threads=1)
            out = [(ids, " ".join(map(names.__getitem__, ids)), corrected or ids != own) for ids, (own, _, corrected) in zip(theirs, out, strict=True)]
        return out


def encoder(model_file: str) -> MergeEncoder:
    """The worker's encoder: what it remembers serves all tasks, until another operator needs the memory."""
    return remembered(("sentencepieces", model_file), lambda: MergeEncoder(model_file))


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", ids: bool = True, decoded: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256, corrected and, as asked, ids (array<int>) and decoded (string).

    Columns of docs with these names are replaced. model_file must exist on every executor (a parameter;
    vocabularies are installed with the workers, never shipped with this library).
    """
    added = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("corrected", pa.bool_())]
    added += [("ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.string())] * decoded
    kept = docs.select("*") if text not in dict(added) else docs
    kept = kept.drop(*[n for n, _ in added if n in docs.columns and n != text])
    spark_types = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "corrected": T.BooleanType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    schema = T.StructType(list(kept.schema.fields) + [T.StructField(n, spark_types[n]) for n, _ in added])

    def run(batches):
        e = encoder(model_file)
        for b in batches:
            texts = b.column(text).to_pylist()
            rows = e.encode_batch(texts)
            back = e.library.decode([r[0] for r in rows]) if rows else []
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            values = {"n_tokens": [len(r[0]) for r in rows], "ids_sha256": [sha(r[1]) for r in rows], "decoded_sha256": [sha(x) for x in back], "corrected": [r[2] for r in rows]}
            if ids:
                values["ids"] = [r[0] for r in rows]
            if decoded:
                values["decoded"] = back
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(values[n], t) for n, t in added)], names=[*b.schema.names, *(n for n, _ in added)])

    return kept.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, default_model(), ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "corrected")
