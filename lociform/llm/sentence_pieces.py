"""SentencePiece encoding and decoding as a shortest path in a weighted transducer.

A model compiles to three machines.

* The normaliser: rules of the model's character map, taken longest first, an identity arc
  for every other character, and the state that white space needs (start, behind a space,
  elsewhere). It is deterministic, so a text has one output.
* The pieces, a trie: one arc for each piece, and for a character that is no piece an arc
  that puts out its bytes (or the unknown piece).
* For BPE models, an acceptor of neighbouring pieces: one may follow another only if
  encoding their joined text gives just these two, which makes an accepted path the one
  that merging in order of rank gives. Unigram models have a single state here.

An input is composed with them lazily, arc by arc from left to right, and the path of
least weight in the tropical semiring is taken: weights are negative scores for unigram
models and the number of ids for BPE models. A place in the text holds one state of the
acceptor: two accepted paths to it would be two encodings of the same prefix. Where
no piece of a BPE model holds a space mark behind another character and none a line feed,
paths are taken word by word and kept in a table that is bounded in bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import parts_of, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of words and their ids that a process keeps; longer words than ``LONG`` are never kept.
KEPT_BYTES, LONG = 128 << 20, 512
#: Pairs of pieces whose acceptance a process keeps: about 60 MB.
KEPT_PAIRS = 500_000
#: How much worse than the worst piece an unknown character is in a unigram model.
PENALTY = 10.0


def character_map(blob: bytes) -> dict[str, str]:
    """The rules (text -> replacement) of a compiled character map.

    The map is a double array of 32-bit cells behind its size, then the replacements, each
    closed by a zero byte.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    cells = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    texts = blob[4 + size :]
    jump = lambda cell: (cell >> 10) << ((cell & 512) >> 6)
    rules: dict[str, str] = {}
    stack = [(jump(cells[0]), b"")]
    while stack:
        base, key = stack.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(cells) or cells[at] & 0x800000FF != byte:
                continue
            below, longer = at ^ jump(cells[at]), key + bytes([byte])
            if cells[at] >> 8 & 1:
                start = cells[below] & 0x7FFFFFFF
                rules[longer.decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
            stack.append((below, longer))
    return rules


class Normaliser:
    """The normalising transducer of a model."""

    def __init__(self, spec, suffix: bool, kept: set[str]):
        self.prefix, self.suffix = spec.add_dummy_prefix, suffix
        self.trims = spec.remove_extra_whitespaces
        self.mark = MARK if spec.escape_whitespaces else " "
        self.kept = kept
        self.rules = character_map(spec.precompiled_charsmap) | {k: k for k in kept}
        self.longest: dict[str, int] = {}
        for k in self.rules:
            self.longest[k[0]] = max(self.longest.get(k[0], 0), len(k))
        #: Whether a text changes in nothing but its spaces.
        self.plain = not self.rules and not self.trims and not suffix and self.mark == MARK

    def chunks(self, text: str):
        """What each longest rule or single character puts out."""
        rules, longest, at, n = self.rules, self.longest, 0, len(text)
        while at < n:
            for k in range(min(longest.get(text[at], 0), n - at), 0, -1):
                if (got := rules.get(text[at : at + k])) is not None:
                    break
            else:
                k, got = 1, text[at]
            yield got
            at += k

    def __call__(self, text: str) -> str:
        """The text with its white space marked."""
        if not text:
            return ""
        out: list[str] = []
        after_space = self.trims
        for got in self.chunks(text):
            if after_space:
                got = got.lstrip(" ")
            if got:
                out.append(got)
                after_space = self.trims and got[-1] == " "
        joined = "".join(out)
        if self.trims:
            joined = joined.rstrip(" ")
            if not joined:
                return ""
        if self.prefix:
            joined = joined + " " if self.suffix else " " + joined
        return joined.replace(" ", self.mark)


_SINGLE = struct.Struct("f")


def single(x: float) -> float:
    """``x`` in single precision."""
    return _SINGLE.unpack(_SINGLE.pack(x))[0]


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        pieces = list(proto.pieces)
        self.bpe = proto.trainer_spec.model_type == 2
        if self.bpe and any(p.type == UNUSED for p in pieces):
            raise ValueError("BPE models with unused pieces are not supported")
        self.users = {p.piece for p in pieces if p.type == USER}
        self.normaliser = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix, self.users)
        self.prefix, self.suffix = self.normaliser.prefix, self.normaliser.suffix
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        unknown = (proto.trainer_spec.unk_surface or " \u2047 ").encode()
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else unknown if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in pieces]
        scores = [p.score for p in pieces if p.type == NORMAL] or [0.0]
        self.unknown_cost = single(PENALTY - min(scores))
        cost = {p.piece: 1.0 if self.bpe else 0.1 - len(p.piece.encode()) * max(scores) if p.type == USER else -p.score for p in pieces}
        # runs of unknown characters, which reach over words, are one id unless they are bytes; sums of weights reach over words
        self.by_word = self.bpe and self.prefix and self.normaliser.plain and bool(self.bytes_of) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        order = sorted((-pieces[i].score, i, p) for p, i in self.ids.items() if p not in self.users)
        self.rank: dict[str, int] = {}
        last, r = None, 0
        for k, (c, _, p) in enumerate(order):
            if c != last:
                last, r = c, k
            self.rank[p] = r
        self.made: dict[str, tuple[str, str]] = {}
        arcs = [p for p in self.ids if p in self.users or not self.bpe or self._merged(p) == [p]]
        #: Trie of the pieces: by the next character, the nodes below it and the arc (piece, weight) that ends there.
        self.trie: dict[str, list] = {}
        for p in arcs:
            node = self.trie
            for c in p:
                end = node.setdefault(c, [{}, None])
                node = end[0]
            end[1] = (p, cost[p])
        #: Which pieces may follow a piece, as far as it was asked.
        self.may: dict[str, dict[str, bool]] = {}
        self.asked = 0
        #: Pairs of characters that stand side by side in a piece.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.kept = 0

    def _merged(self, text: str) -> list[str]:
        """Merging in order of rank, leftmost first; remembers how a text that ends as one piece was made."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank), default=None)
            if best is None:
                break
            k = best[1]
            if len(parts) == 2:
                self.made[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether the acceptor lets piece ``b`` stand behind piece ``a``.

        The merges that made both are undone, the latest first; if at any time the parts
        at the seam would have merged before the next part was made, it doesn't. Nothing
        merges with a piece that the model's user has set.
        """
        rank, made = self.rank, self.made
        if a in self.users or b in self.users:
            return True
        limit = 1 << 60
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                return False
            rank_a = rank.get(a, -1) if a in made else -1
            rank_b = rank.get(b, -1) if b in made else -1
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, a = rank_a, made[a][1]
            else:
                limit, b = rank_b + 1, made[b][0]

    def path(self, text: str) -> list[int]:
        """Ids on the path of least weight through ``text``, which is normalised."""
        ids, out, unknown = self.ids, [], False
        for p in self.least_path(text):
            if (i := ids.get(p)) is not None:
                out.append(i)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not unknown:
                out.append(self.unknown)  # unknown characters in a row are one
            unknown = i is None
        return out

    def least_path(self, text: str) -> list[str]:
        """The pieces, and characters that are none, on the path of least weight.

        Arcs are relaxed from left to right, of equal paths to a place the first stays; weights
        of unigram paths are kept in single precision, which decides between near ties. In a
        BPE model the places that lie inside a piece of the model's user are not left.
        """
        trie, may, bpe, n = self.trie, self.may, self.bpe, len(text)
        inside = self._inside_users(text) if self.users and bpe else ()
        far = float("inf")
        weight = [far] * (n + 1)
        weight[0] = 0.0
        back = [""] * (n + 1)
        for i in range(n):
            if (w := weight[i]) == far:
                continue
            last, end, j = back[i], trie.get(text[i]), i + 1
            after = may.get(last)
            # a character that is no piece is an arc too; then the pieces, the shortest first
            arc = end[1] if end is not None and end[1] is not None else self._raw(text[i])
            while True:
                if arc is not None:
                    p, c = arc
                    to = w + c if bpe else single(w + c)
                    if to < weight[j] and not (inside and (inside[i] or inside[j] or any(inside[i + 1 : j]) != (p in self.users and len(p) > 1))):
                        if not bpe:
                            weight[j], back[j] = to, p
                        elif self._asked(last, p) if after is None or (ok := after.get(p)) is None else ok:
                            weight[j], back[j] = to, p
                if end is None or j == n or (end := end[0].get(text[j])) is None:
                    break
                arc = end[1]
                j += 1
        out, at = [], n
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def _raw(self, c: str) -> tuple[str, float]:
        """The arc of a character that is no piece."""
        return c, float(len(c.encode("utf-8", "surrogatepass"))) if self.bpe else self.unknown_cost

    def _asked(self, a: str, b: str) -> bool:
        """``follows``, remembered."""
        if self.asked >= KEPT_PAIRS:
            for known in self.may.values():
                known.clear()
            self.asked = 0
        self.asked += 1
        ok = self.may.setdefault(a, {})[b] = not a or self.follows(a, b)
        return ok

    def _inside_users(self, text: str) -> list[bool]:
        """Which places lie inside the leftmost longest pieces of the model's user."""
        found, at = [False] * (len(text) + 1), 0
        longest = max(map(len, self.users))
        while at < len(text):
            k = next((k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in self.users), 1)
            for i in range(at + 1, at + k):
                found[i] = True
            at += k
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a word. It is cut where no piece holds the two characters side by side: no path differs by that."""
        text, start, got, inner = word if word[:1] == "\n" else MARK + word, 0, b"", self.inner
        for k in range(1, len(text) + 1):
            if text[k - 1 : k + 1] not in inner:
                part = text[start:k]
                known, name = (self.words, part[1:]) if part[0] == MARK else (self.parts, part)
                if (ids := known.get(name)) is None:
                    ids = self.path(part)
                    ids = self._keep(known, name, struct.pack(f"<{len(ids)}i", *ids))
                if k == len(text) and not start:
                    return ids
                got += ids
                start = k
        return self._keep(self.words, word, got)

    def _keep(self, table: dict[str, bytes], word: str, got: bytes) -> bytes:
        if len(word) <= LONG:
            size = 200 + 4 * len(word) + len(got)
            if self.kept + size > KEPT_BYTES:
                self.words.clear()
                self.parts.clear()
                self.kept = 0
            table[word] = got
            self.kept += size
        return got

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if not self.by_word:
            return np.array(self.path(self.normaliser(text)), "<i4").tobytes()
        words = text.replace(MARK, " ").replace("\n", " \n").split(" ")
        if "" in words:
            words = _runs(words)
        kept = self.words
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            return b"".join([got if (got := kept.get(w)) is not None else self._word(w) for w in words])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none."""
        return np.frombuffer(self.encode_bytes(text or ""), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        if self.prefix and self.suffix:
            raw = raw[:-1] if raw[-1:] == b" " else raw
        elif self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _runs(words: list[str]) -> list[str]:
    """Empty words stand for space marks; each run joins the word behind it, unless that starts a line."""
    out: list[str] = []
    marks = 0
    for w in words:
        if not w:
            marks += 1
        elif w[0] == "\n":
            if marks:
                out.append(MARK * (marks - 1))
            out.append(w)
            marks = 0
        else:
            out.append(MARK * marks + w)
            marks = 0
    if marks:
        out.append(MARK * (marks - 1))
    return out


_compiled: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The model's transducer, compiled once in each process."""
    key = hashlib.blake2b(model, digest_size=16).digest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ids(encoded: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(e) // 4 for e in encoded], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of each whole text. Null and empty texts have no ids.

    Null ids and repeated rows are kept; other columns are not read; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        t = compiled(shared.value)
        for batch in batches:
            for part in parts_of(batch):
                encoded = [t.encode_bytes(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(e) // 4 for e in encoded], pa.int64()), _ids(encoded)], names=["id", "n_tokens", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, model: bytes, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        t = compiled(shared.value)
        for batch in batches:
            for part in parts_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op8_sentence_pieces(spark, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) of every whole text.

    ids_sha256: of the ids as little-endian 32-bit numbers. A null text counts as empty.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        t = compiled(shared.value)
        for batch in batches:
            for part in parts_of(batch):
                out: dict[str, list] = {n: [] for n in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip")}
                for text in part.column(1).to_pylist():
                    ids = t.encode_bytes(text or "")
                    back = t.decode(np.frombuffer(ids, "<i4").tolist())
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    out["round_trip"].append(back == (text or ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out["n_tokens"], pa.int64()), *(pa.array(out[n]) for n in ("ids_sha256", "decoded_sha256", "round_trip"))], names=["doc_id", *out])

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
