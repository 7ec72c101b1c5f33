"""Chat formatting at token level.

Every segment (a role, a text) is encoded on its own; the template's control tokens are
reserved ids behind the vocabulary, spliced between segments. So no text can produce a
control token, and no token spans two segments. The loss mask is the running sum of +1 at
the first and -1 behind the last token of each trained text.

Rendered as a string, the control tokens have names. A name that occurs inside a role or
text is escaped reversibly before encoding: MARK is written behind its first character, and
every MARK of the text itself is doubled. Unescaping drops one MARK of each pair or single.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is divided over
tasks. Each task encodes its rows and counts the tokens of its first and last conversation; from these
two counts a task, the driver tells where the conversations go on in the next tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import cut
from .textcore import trim

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Names of the control tokens, by their place behind the vocabulary; the last two occur in other templates only.
BEGIN, END, TURN, TEXT, STOP = "<s>", "</s>", "<|turn|>", "<|text|>", "<|stop|>"
CONTROL = (BEGIN, END, TURN, TEXT, STOP, "[INST]", "[/INST]")
MARK = "␛"
#: Control tokens of each turn.
TOKENS = 3
_NAMES = re.compile("|".join(map(re.escape, CONTROL)))
_MARKS = re.compile(f"{MARK}({MARK}?)")

_made: dict[int, object] = {}


def escape(text: str) -> str:
    if MARK in text:
        text = text.replace(MARK, MARK * 2)
    if "<" in text or "[" in text:
        text = _NAMES.sub(lambda m: m[0][0] + MARK + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return _MARKS.sub(r"\1", text) if MARK in text else text


def first_reserved(vocabulary: bytes) -> int:
    """The first id behind a vocabulary."""
    return max(int(line.split()[1]) for line in vocabulary.splitlines()) + 1


class Codec:
    """A tiktoken vocabulary with reserved ids behind it; pickles as the vocabulary's bytes."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.base = first_reserved(vocabulary)
        self.enc = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a whole escaped text, however long."""
        return self.enc.encode_ordinary(text)

    def decode(self, ids) -> str:
        return self.enc.decode_bytes(list(ids)).decode("utf-8")

    def control(self, name: str) -> int:
        return self.base + CONTROL.index(name)


def _codec(shared) -> Codec:
    """The codec of a broadcast vocabulary, made once in a worker."""
    key = hash(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = Codec(shared.value)
    return _made[key]


def _shared(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _strings(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def format_chat(df: DataFrame, vocabulary: str = VOCABULARY, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format conversations (conv_id, turn, role, text) into one row per turn.

    Result: conv_id, position (0-based turn in its conversation), start (tokens of the conversation
    before it), ids and loss (1 for tokens to be trained on: the text of the trained roles). A
    conversation is the concatenation of its rows by position, which is also their order in a
    partition: BEGIN, then TURN role TEXT text STOP for each turn, then END. Each role and text is encoded whole.

    Turns go by (turn, role, text), nulls first; repeated rows are turns of their own. Null roles and
    texts are empty; a null conv_id is a conversation like any other. Other columns are ignored.
    """
    shared = _shared(df, vocabulary)
    kind = df.schema["conv_id"].dataType
    keys = ["conv_id", "turn", "role", "text", "_row"]  # the last one divides even equal rows
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    part_type = to_arrow_type(kind)

    def encode(batches):
        codec = _codec(shared)
        for b in batches:
            out = []
            for name in ("role", "text"):
                ids = [np.array(codec.encode(escape(x)), np.int32).tobytes() for x in _strings(b.column(name))]
                out.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("role"), *out], names=["conv_id", "role", "role_ids", "text_ids"])

    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    encoded = cut(dealt.mapInArrow(encode, T.StructType([T.StructField("conv_id", kind), T.StructField("role", T.StringType()), T.StructField("role_ids", T.BinaryType()), T.StructField("text_ids", T.BinaryType())])))

    def ends(batches):
        """Rows and tokens of a task's first and last conversation, which may be one."""
        at, seen = TaskContext.get().partitionId(), []
        for b in batches:
            tokens = TOKENS + (pc.binary_length(b.column("role_ids")).to_numpy() + pc.binary_length(b.column("text_ids")).to_numpy()) // 4
            for c, n in zip(b.column("conv_id").to_pylist(), tokens.tolist(), strict=True):
                if not seen or seen[-1][0] != c:
                    seen = [*seen[:1], [c, 0, 0]]
                seen[-1][1] += 1
                seen[-1][2] += n
        if seen:
            columns = [pa.array([at], pa.int32()), *(pa.array([x], t) for e in (seen[0], seen[-1]) for x, t in zip(e, (part_type, pa.int64(), pa.int64()), strict=True)), pa.array([len(seen) == 1])]
            yield pa.RecordBatch.from_arrays(columns, names=summary.names)

    pair = lambda p: [T.StructField(f"{p}_conv", kind), T.StructField(f"{p}_rows", T.LongType()), T.StructField(f"{p}_tokens", T.LongType())]
    summary = T.StructType([T.StructField("part", T.IntegerType()), *pair("first"), *pair("last"), T.StructField("single", T.BooleanType())])
    parts = sorted(tuple(r) for r in encoded.select("conv_id", "role_ids", "text_ids").mapInArrow(ends, summary).collect())
    before: dict[int, tuple[int, int, bool]] = {}  # rows and tokens of a task's first conversation in earlier tasks, and whether its last one ends there
    rows_, tokens_, current = 0, 0, object()
    for i, (part, first, f_rows, f_tokens, last, l_rows, l_tokens, single) in enumerate(parts):
        carried = (rows_, tokens_) if first == current else (0, 0)
        rows_, tokens_ = (carried[0] + f_rows, carried[1] + f_tokens) if single else (l_rows, l_tokens)
        current = last
        before[part] = (*carried, i + 1 == len(parts) or parts[i + 1][1] != last)

    out = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss", T.ArrayType(T.ByteType()))])
    begin, end, turn, text, stop = (first_reserved(shared.value) + CONTROL.index(name) for name in (BEGIN, END, TURN, TEXT, STOP))

    def splice(batches):
        at, done, last_ends = before.get(TaskContext.get().partitionId(), (0, 0, True))
        for part, ends_here in _with_next(batches, last_ends):
            conv, position, start, ids, loss = [], [], [], [], []
            for (c, role, r, t), last in zip(part, ends_here, strict=True):
                r, t = np.frombuffer(r, np.int32), np.frombuffer(t, np.int32)
                head = [begin, turn] if at == 0 else [turn]
                seq = np.concatenate([head, r, [text], t, [stop, end] if last else [stop]]).astype(np.int32)
                delta = np.zeros(len(seq) + 1, np.int8)
                if role in trained:
                    first = len(head) + len(r) + 1
                    delta[first] += 1
                    delta[first + len(t)] -= 1
                conv.append(c), position.append(at), start.append(done + (at > 0)), ids.append(seq), loss.append(np.cumsum(delta[:-1], dtype=np.int8))
                at, done = (0, 0) if last else (at + 1, done + TOKENS + len(r) + len(t))
            columns = [pa.array(conv, part_type), pa.array(position, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return encoded.mapInArrow(splice, out)


def _with_next(batches, last_ends: bool) -> Iterator[tuple[list[tuple], list[bool]]]:
    """Rows (conversation first) and whether they end their conversation, for the last row as last_ends says; one row is held back."""
    held = []
    for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
        rows = held + list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = rows[-1:]
        if len(rows) > 1:
            yield rows[:-1], [x[0] != y[0] for x, y in zip(rows[:-1], rows[1:], strict=True)]
    if held:
        yield held, [last_ends]


def read_chat(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Read formatted conversations back from their tokens: one row per conversation.

    Result: conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars and
    loss_sha256 (of all text under the loss mask, unescaped), formatted_chars (code points of the
    rendered string), n_tokens, loss_tokens. Rows are put in order by position first, so they may come from anywhere.
    A conversation is read in one task (its digests are sequential), with the memory of one turn. No rows give no result.
    """
    shared = _shared(formatted, vocabulary)
    kind = formatted.schema["conv_id"].dataType
    out = T.StructType([T.StructField("conv_id", kind)] + [T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")])

    arrow = to_arrow_schema(out)

    def digest(batches):
        codec = _codec(shared)
        names = {codec.base + i: n for i, n in enumerate(CONTROL)}
        turn, text = codec.control(TURN), codec.control(TEXT)
        state, current = None, None
        for b in batches:
            done = []
            conv, positions = b.column("conv_id").to_pylist(), b.column("position").to_pylist()
            for c, position, seq, mask in zip(conv, positions, b.column("ids"), b.column("loss"), strict=True):
                if position == 0:
                    if state is not None:
                        done.append(_row(current, state))
                    current, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                seq, mask = seq.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(seq >= codec.base)
                state[5] += len(seq)
                state[6] += int(mask.sum())
                for i, j in zip(at, [*at[1:], len(seq)], strict=True):
                    state[4] += len(names[int(seq[i])])
                    body = seq[i + 1 : j]
                    raw = codec.decode(body) if len(body) else ""
                    state[4] += len(raw)
                    if seq[i] == turn or seq[i] == text:
                        state[0] += int(seq[i] == turn)
                        plain = unescape(raw)
                        state[1].update(plain.encode() + b"\n")
                    trained = body[mask[i + 1 : j] > 0]
                    if len(trained):
                        plain = unescape(codec.decode(trained))
                        state[2] += len(plain)
                        state[3].update(plain.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([_row(current, state)], schema=arrow)
        trim()

    def _row(c, s):
        return dict(zip(out.names, [c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]], strict=True))

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "position", "ids", "loss").mapInArrow(digest, out)
