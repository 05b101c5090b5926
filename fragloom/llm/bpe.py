"""BPE as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

For a merge list whose operands are always older than their merge, the encoding of a prefix is fixed by one token:
its last one. Exactly one vocabulary token that ends there can stand beside the prefix before it (no merge crosses
their border). The encoder keeps these last tokens for the longest token's span, so each symbol costs a few look-ups,
and emits every token that all of the still open prefixes share. A chain of merges that undo each other's borders has
strictly rising ranks; the longest such chain times the longest token bounds how far a new symbol can reach back.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fragloom.llm.common import released, remembered, texts

# The file's split pattern, and the printable stand-ins of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
MEMO = 1 << 18  # strings and token pairs remembered per worker; the rest is computed anew


def byte_signs() -> list[str]:
    """Sign of each byte: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, n = [""] * 256, 256
    for b in range(256):
        if b in own:
            signs[b] = chr(b)
        else:
            signs[b] = chr(n)
            n += 1
    return signs


class Vocabulary:
    """Tokens, merges and the facts the transducer needs of them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        born = {}  # token -> rank of its merge, -1 for single symbols
        self.parts: dict[int, tuple[int, int]] = {}
        self.text = {i: t for t, i in self.ids.items()}
        for r, pair in enumerate(model["merges"]):
            a, b = (self.ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.ids[self.text[a] + self.text[b]]
            if born.get(a, -1) >= r or born.get(b, -1) >= r or made in born:
                raise ValueError("a merge uses a token that is made later, or makes one twice")
            born[made], self.parts[made], self.rank[a, b] = r, (a, b), (r, made)
        self.born = born
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.text.update({i: t for t, i in self.added.items()})
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.signs = byte_signs()
        self.longest = max(len(self.symbols(t)) for t in self.ids)
        self.chain = self._chain()
        self.lookahead = self.chain * self.longest
        self.size: dict[int, int] = {}  # token -> number of symbols
        self.shorter: dict[int, int] = {}  # token -> the longest other token that it ends with, or -1
        self.starts: set[str] = {""}  # every beginning of a token
        for token, i in self.ids.items():
            own = self.symbols(token)
            self.size[i] = len(own)
            self.shorter[i] = next((t for k in range(1, len(own)) if (t := self.ids.get("".join(own[k:]))) is not None), -1)
            self.starts.update("".join(own[:k]) for k in range(1, len(own) + 1))
        self.root: dict = {}
        self._nodes: dict[str, dict] = {"": self.root}
        self._names: dict[int, str] = {id(self.root): ""}
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, tuple[int, ...]] = {"": ()}

    @staticmethod
    def symbols(token: str) -> list[str]:
        end = token.endswith(WORD_END) and len(token) > len(WORD_END)
        body = token[: -len(WORD_END)] if end else token
        return [*body[:-1], body[-1] + WORD_END] if end else list(body)

    def _chain(self) -> int:
        """Longest list of merges, ranks rising, each of which needs at its right border what the one before takes.

        Merge (a, b) takes a away from every merge whose right operand begins with a.
        """
        taken: dict[int, int] = {}  # left operand -> longest chain that ends in a merge taking it
        best = 1
        for (a, b), (_, _) in self.rank.items():  # in rank order
            length, x = 1 + taken.get(b, 0), b
            while x in self.parts:
                x = self.parts[x][0]
                length = max(length, 1 + taken.get(x, 0))
            best = max(best, length)
            if length > taken.get(a, 0):
                taken[a] = length
        return best

    def apart(self, left: int, right: int) -> bool:
        """True if no merge crosses the border when both are built beside each other.

        The border's neighbours grow along the right edge of ``left`` and the left edge of ``right``. A pair on the
        two edges merges if its rank comes before both neighbours go on (equal rank: the one further left is first).
        """
        never = 1 << 60
        x, x_goes = left, never
        y, y_goes = right, never
        ok = True
        while True:
            hit = self.rank.get((x, y))
            if hit is not None and hit[0] < x_goes and hit[0] <= y_goes:
                ok = False
                break
            x_born, y_born = self.born.get(x, -1), self.born.get(y, -1)
            if x_born < 0 and y_born < 0:
                break
            if x_born > y_born:
                x_goes, x = x_born, self.parts[x][1]
            else:
                y_goes, y = y_born, self.parts[y][0]
        if len(self._pairs) < MEMO:
            self._pairs[left << 20 | right] = ok
        return ok

    def _step(self, node: dict, symbol: str) -> tuple[dict, int]:
        """Automaton of token beginnings, built where texts go: next state and the longest token that ends here."""
        state = self._names[id(node)] + symbol
        own = self.symbols(state)
        for k in range(len(own) + 1):
            rest = "".join(own[k:])
            if rest in self.starts:
                break
        token = next(t for k in range(len(own)) if (t := self.ids.get("".join(own[k:]))) is not None)
        if rest not in self._nodes:
            self._nodes[rest] = {}
            self._names[id(self._nodes[rest])] = rest
        node[symbol] = self._nodes[rest], token
        return node[symbol]

    def stream(self, symbols: Iterable[str], emit) -> None:
        """Call ``emit`` with lists of tokens of one word, each as soon as no later symbol can change it.

        Memory: the last ``lookahead`` symbols' tokens, at most twice that between two clean-ups.
        """
        last: list[int] = []  # last token of the prefix that ends at each symbol not emitted
        back: list[int] = []  # where that token starts, relative to the first of them
        opened = -1  # token before them
        node, n, limit = self.root, 0, 2 * self.lookahead
        size, shorter, pairs = self.size, self.shorter, self._pairs
        for s in symbols:
            node, token = node.get(s) or self._step(node, s)
            n += 1
            while True:
                start = n - size[token]
                if start >= 0:
                    before = last[start - 1] if start else opened
                    if before < 0:
                        break
                    ok = pairs.get(before << 20 | token)
                    if ok or ok is None and self.apart(before, token):
                        break
                token = shorter[token]
            last.append(token)
            back.append(start)
            if n >= limit:
                done = self._stable(back)
                if done:
                    tokens = self._path(last, back, done)
                    emit(tokens)
                    opened = tokens[-1]
                    last, back, n = last[done:], [b - done for b in back[done:]], n - done
        emit(self._path(last, back, n))

    def _stable(self, back: list[int]) -> int:
        """End of the longest token path that all prefixes a later token can follow have in common."""
        live = set(range(len(back) - self.longest, len(back)))
        live = {x + 1 for x in live if x >= 0}
        while len(live) > 1:
            end = max(live)
            live.discard(end)
            live.add(back[end - 1])
            if 0 in live or min(live) < 0:
                return 0
        return live.pop()

    @staticmethod
    def _path(last: list[int], back: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end = back[end - 1]
        return out[::-1]

    def word(self, word: str, out: list[int]) -> None:
        signs = [self.signs[b] for b in word.encode("utf-8")]
        signs[-1] += WORD_END
        self.stream(signs, out.extend)

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of text without spaces and line feeds: normal form, lower case, words."""
        piece = chunk if chunk.isascii() or unicodedata.is_normalized("NFC", chunk) else unicodedata.normalize("NFC", chunk)
        # letter by letter, as the capital sigma has no other form at a word's end here
        piece = piece.replace("Σ", "σ").lower()
        out: list[int] = []
        for word in self.split.findall(piece):
            self.word(word, out)
        known = tuple(out)
        if len(self._chunks) < MEMO and len(chunk) < 64:
            self._chunks[chunk] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text: added tokens first, then chunks between spaces and line feeds, which no word crosses."""
        out: list[int] = []
        known = self._chunks
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.added[piece])
                continue
            for chunk in piece.replace("\n", " ").split(" "):
                ids = known.get(chunk)
                out.extend(self.chunk(chunk) if ids is None else ids)
        return out

    def decoder(self, plain: bool = False) -> Decoder:
        return Decoder(self, plain)


class Decoder:
    """Ids in, text out, piece by piece; the state is the place inside an unfinished character and the joint.

    As the file has no decoder of its own, the library's text is the tokens joined by a space; ``plain`` turns byte
    signs and word ends back into the words. Bytes go through a UTF-8 automaton: wrong ones become U+FFFD, one for each
    longest wrong prefix.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        import codecs

        self.v, self.plain = vocabulary, plain
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.joint = ""
        if plain:
            of_sign = {s: b for b, s in enumerate(vocabulary.signs)}
            self.bytes = {}
            for i, token in vocabulary.text.items():
                end = token.endswith(WORD_END) and len(token) > len(WORD_END)
                body = token[: -len(WORD_END)] if end else token
                added = i in vocabulary.added.values()
                self.bytes[i] = token.encode() + b" " if added else bytes(of_sign[c] for c in body) + b" " * end

    def feed(self, ids: list[int]) -> str:
        """Text that is certain after these ids; ids the vocabulary lacks add nothing."""
        if self.plain:
            return self.utf8.decode(b"".join([self.bytes.get(i, b"") for i in ids]))
        text = self.v.text
        pieces = [text[i] for i in ids if i in text]  # whole characters: the joint is the only state
        if not pieces:
            return ""
        out = self.joint + " ".join(pieces)
        self.joint = " "
        return out

    def end(self) -> str:
        """What an unfinished character leaves; the machine is then as new."""
        self.joint = ""
        out = self.utf8.decode(b"", True)
        self.utf8.reset()
        return out


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file, until tasks of another operator come."""
    return remembered(f"vocabulary {path}", lambda: Vocabulary(path))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: id, ``ids`` and ``decoded``; with ``digest`` their sizes and sha256 instead of the lists themselves.

    Whole texts, no shuffle; null and empty texts give no ids and empty text. Rows with equal or null ids are kept
    apart; an empty table gives no rows; other columns are not read.
    """
    rows = texts(docs, id_col, text_col).withColumnRenamed("_id", id_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        number = {i: str(i) for i in v.text}
        machine = v.decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                chunk = batch.slice(at, 64)
                out = []
                for text in chunk.column(1).to_pylist():
                    ids = v.encode(text or "")
                    decoded = "".join([*(machine.feed(ids[k : k + 4096]) for k in range(0, len(ids), 4096)), machine.end()])
                    if digest:
                        out.append((len(ids), hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
                    else:
                        out.append((len(ids), ids, decoded))
                kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.int64(), pa.list_(pa.int32()), pa.string())
                names = ("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("n_tokens", "ids", "decoded")
                yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], [id_col, *names])

    kept = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return rows.mapInArrow(released(run, keep=True), f"`{id_col}` {id_type}, n_tokens long, {kept}")
