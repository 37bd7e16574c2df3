"""Subject areas of documents: averaged word and subword embeddings, independent logistic outputs.

A word is the mean of the embeddings of its hashed parts (itself and its runs of 4 letters), a
text the mean of its words, and every subject has a logistic output of its own on that mean.

* Training reads at most ``MAX_LABELLED`` labelled documents (those of the least hash of their
  id; a documented bound, so the model's cost does not grow with the corpus). They are packed
  into blocks once; in each round every block gives the gradient of its documents under
  the current parameters, the gradients are added up over the blocks of each task and then over all
  tasks, and one Adam step follows. Only gradients travel, tasks x parameters, a bound that no data changes.
* Scoring reads every document, whole. As outputs are linear in the mean, each distinct word of
  a batch is scored once; sentences are means of their words' scores. A document is on the
  subjects that take up more than ``SHARE`` of its sentences.

Words are runs of letters, lower-cased, so all languages share one model. Null, empty and
wordless texts are on no subject. Training is deterministic for given tables.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import key
from loomgraph.session import cut

MAX_LABELLED = 20_000
BUCKETS, DIM, GRAM = 1 << 15, 16, 4
BLOCKS, ROUNDS, RATE, DECAY = 12, 25, 0.15, 1e-5
#: A sentence is on a subject from this probability on; a document, above this share of sentences
#: (between the fifth of passing remarks and the third of a subject).
SENTENCE_P, SHARE = 0.5, 0.27

#: Stretches of fewer words (headings, log lines, numbers of lists) are no sentences, unless a
#: text has nothing else.
SENTENCE_WORDS = 5

TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
P = np.uint64(0x100000001B3)
M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _ends() -> tuple[np.ndarray, np.ndarray]:
    stop, space = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    stop[[ord(c) for c in ".!?…"]] = True
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        space[c] = True
    return stop, space


def cleaned(text: str) -> str:
    """Without markup; UTF-8 once read as another encoding is put right where possible."""
    if "<" in text:
        text = TAG.sub("\n", text)
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return text


def words_and_sentences(texts: list[str]):
    """Distinct words, and for each word in order its code, sentence and text number."""
    texts = [cleaned(t) for t in texts]
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts = edge[0::2]
    if not len(starts):
        none = np.empty(0, np.int64)
        return [], none, none, none
    width = np.ones(len(points), np.int64)
    for least in (0x7F, 0x7FF, 0xFFFF):
        width += points > least
    at = np.concatenate(([0], np.cumsum(width)))
    cuts = np.concatenate(([0], edge[edge > 0], [len(points)]))
    cuts = cuts[np.concatenate(([True], np.diff(cuts) > 0))]
    raw = joined.encode("utf-8", "surrogatepass")
    tiles = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(at[cuts].astype(np.int64)), pa.py_buffer(raw))
    code = tiles.take(pa.array(np.searchsorted(cuts, starts))).dictionary_encode()
    stop, space = _ends()
    # A sentence ends with a stop before white space, or with a line.
    gap = points == 10
    gap[1:] |= stop[points[:-1]] & space[points[1:]]
    sentence = np.cumsum(gap)[starts]
    line_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text = np.searchsorted(line_ends, starts, side="right")
    return code.dictionary.to_pylist(), code.indices.to_numpy().astype(np.int64), sentence, text


def word_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words' parts laid end to end, and where each word begins (n + 1)."""
    marked = [f"<{w.lower()}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    gram = np.zeros(len(points), np.uint64)
    for k in range(GRAM):
        gram[: len(points) - k] = gram[: len(points) - k] * P + points[k:]
    count = np.maximum(sizes - GRAM + 1, 0)
    ptr = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.empty(ptr[-1], np.int64)
    whole = pd.util.hash_array(np.array(marked, dtype=object), categorize=False)
    out[ptr[:-1]] = (whole >> np.uint64(20)).astype(np.int64) % BUCKETS
    word = np.repeat(np.arange(len(words)), count)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    out[ptr[word] + 1 + nth] = (gram[starts[word] + nth] * M >> np.uint64(33)).astype(np.int64) % BUCKETS
    return out, ptr


def _mean_rows(table: np.ndarray, parts: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[parts], ptr[:-1], axis=0) / np.diff(ptr)[:, None].astype(table.dtype)


def block_of(texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Bag-of-words of labelled texts in arrays; texts without words are left out."""
    words, code, _, text = words_and_sentences(texts)
    pairs, counts = np.unique(text * len(words) + code, return_counts=True)
    doc, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    rows, inv = np.unique(doc, return_inverse=True)
    total = np.bincount(inv, counts)
    parts, ptr = word_parts(words) if words else (np.empty(0, np.int64), np.zeros(1, np.int64))
    return {
        "doc": inv.astype(np.int32),
        "word": word.astype(np.int32),
        "weight": (counts / total[inv]).astype(np.float32) if len(inv) else np.empty(0, np.float32),
        "parts": parts.astype(np.int32),
        "ptr": ptr.astype(np.int32),
        "labels": labels[rows].astype(np.float32) if len(rows) else labels[:0].astype(np.float32),
    }


def start(subjects: int) -> dict[str, np.ndarray]:
    own = np.random.Generator(np.random.PCG64(7))
    return {
        "E": (own.random((BUCKETS, DIM), np.float32) - 0.5) * np.float32(0.2),
        "W": (own.random((DIM, subjects), np.float32) - 0.5) * np.float32(0.2),
        "b": np.full(subjects, -2.0, np.float32),
    }


def gradient(block: dict[str, np.ndarray], params: dict[str, np.ndarray]) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, number of documents and summed gradients of one block."""
    labels = block["labels"]
    n = len(labels)
    zero = {k: np.zeros_like(v) for k, v in params.items()}
    if not n:
        return 0.0, 0, zero
    u = _mean_rows(params["E"], block["parts"], block["ptr"])
    heads = np.flatnonzero(np.diff(block["doc"], prepend=-1))
    x = np.add.reduceat(u[block["word"]] * block["weight"][:, None], heads, axis=0)
    z = x @ params["W"] + params["b"]
    p = 1 / (1 + np.exp(-z))
    loss = float(-(labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7)).sum())
    dz = (p - labels).astype(np.float32)
    dx = dz @ params["W"].T
    order = np.argsort(block["word"], kind="stable")
    word = block["word"][order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    du = np.zeros_like(u)
    du[word[first]] = np.add.reduceat(dx[block["doc"][order]] * block["weight"][order][:, None], first, axis=0)
    du /= np.diff(block["ptr"])[:, None].astype(np.float32)
    owner = np.repeat(np.arange(len(u)), np.diff(block["ptr"]))
    order = np.argsort(block["parts"], kind="stable")
    part = block["parts"][order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    zero["E"][part[first]] = np.add.reduceat(du[owner[order]], first, axis=0)
    zero["W"], zero["b"] = x.T @ dz, dz.sum(0)
    return loss, n, zero


class Adam:
    """The update rule on the driver."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = RATE) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + DECAY * params[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def score(texts: list[str], table: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, subject number) of the subjects of texts; ``table``: output of each part."""
    words, code, sentence, text = words_and_sentences(texts)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = _mean_rows(table, *word_parts(words))
    heads = np.flatnonzero(np.diff(sentence, prepend=-1))
    size = np.diff(np.concatenate((heads, [len(sentence)])))
    z = np.add.reduceat(own[code], heads, axis=0) / size[:, None].astype(np.float32) + bias
    of = text[heads]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    long = size >= SENTENCE_WORDS
    any_long = np.add.reduceat(long, first, dtype=np.int64) > 0
    counted = long | ~np.repeat(any_long, np.diff(np.concatenate((first, [len(of)]))))
    # Every subject has an output of its own; of those on, a sentence counts for the likeliest, as
    # at few labels counting it for all of them costs a third of the precision.
    on = (z >= np.float32(np.log(SENTENCE_P / (1 - SENTENCE_P)))) & (z == z.max(axis=1, keepdims=True))
    on &= counted[:, None]
    share = np.add.reduceat(on, first, axis=0, dtype=np.float32) / np.add.reduceat(counted, first, dtype=np.float32)[:, None]
    row, subject = np.nonzero(share > SHARE)
    return of[first][row], subject


def labelled(documents: DataFrame, subject_labels: DataFrame, names: list[str], limit: int) -> DataFrame:
    """(id, text, on array<boolean> by subject) of at most ``limit`` labelled documents. Subjects
    are compared without case and outer white space; null and unknown ones are left out."""
    marks = subject_labels.select(F.col("doc_id").alias("id"), key(F.col("subject")).alias("s"))
    marks = marks.where(F.col("s").isin(names)).groupBy("id").agg(F.collect_set("s").alias("have"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = documents.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    on = F.array(*[F.array_contains("have", n) for n in names])
    return texts.join(F.broadcast(chosen), "id").select("id", "text", on.alias("on"))


def train(documents: DataFrame, subject_labels: DataFrame, names: list[str], limit: int = MAX_LABELLED, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` synchronous gradient steps over all blocks."""
    own = labelled(documents, subject_labels, names, limit)
    keyed = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(range(table.num_rows), key=lambda i: table.column("id")[i].as_py())
        texts = table.column("text").take(rows).to_pylist()
        marks = np.array(table.column("on").take(rows).to_pylist(), dtype=bool)
        block = block_of(texts, marks)
        shapes = {k: v.shape for k, v in block.items()}
        meta = ";".join(f"{k},{v.dtype.str},{'x'.join(map(str, shapes[k]))}" for k, v in block.items())
        return pa.table({"block": table.column("block").slice(0, 1), "meta": [meta], "data": pa.array([b"".join(v.tobytes() for v in block.values())], pa.binary())})

    context = documents.sparkSession.sparkContext
    tasks = min(BLOCKS, context.defaultParallelism)
    blocks = cut(keyed.groupBy("block").applyInArrow(build, "block int, meta string, data binary").repartitionByRange(tasks, "block"))
    params = start(len(names))
    rule = Adam(params)
    for _ in range(rounds):
        sent = context.broadcast(params)

        def slopes(batches, sent=sent):
            # A task adds up its own blocks, so that one sum of each task travels.
            first, count, total = 0, 0, None
            for batch in batches:
                for number, meta, data in zip(*(batch.column(c).to_pylist() for c in ("block", "meta", "data"))):
                    block, at = {}, 0
                    for entry in meta.split(";"):
                        name, kind, shape = entry.split(",")
                        dims = tuple(int(x) for x in shape.split("x"))
                        size = int(np.prod(dims)) * np.dtype(kind).itemsize
                        block[name] = np.frombuffer(data, kind, count=int(np.prod(dims)), offset=at).reshape(dims)
                        at += size
                    _, n, grads = gradient(block, sent.value)
                    flat = np.concatenate([grads[k].ravel() for k in ("E", "W", "b")]).astype(np.float64)
                    first, count, total = (number, n, flat) if total is None else (first, count + n, total + flat)
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first], pa.int32()), pa.array([count], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())],
                    ["block", "n", "grads"],
                )

        rows = blocks.mapInArrow(slopes, "block int, n long, grads binary").collect()
        count = sum(r["n"] for r in rows)
        sent.unpersist()
        if not count:
            break
        rows.sort(key=lambda r: r["block"])
        total = sum(np.frombuffer(r["grads"], np.float32).astype(np.float64) for r in rows) / count
        del rows
        grads, at = {}, 0
        for k in ("E", "W", "b"):
            grads[k] = total[at : at + params[k].size].reshape(params[k].shape).astype(np.float32)
            at += params[k].size
        rule.step(params, grads)
        params = {k: v.copy() for k, v in params.items()}
    return params


def subject_names(subjects: DataFrame) -> dict[str, str]:
    """Subjects as compared -> as written; a small table by definition (at most 1,000 rows)."""
    rows = subjects.select("subject").where("subject is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 subjects")
    return {r["subject"].strip().lower(): r["subject"] for r in sorted(rows)}


def document_subjects(documents: DataFrame, subject_labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject: one row for each subject that a document is on. Without labels or
    subjects the result is empty."""
    written = subject_names(subjects)
    names = sorted(written)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    own = documents.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    shape = f"doc_id {id_type}, subject string"
    if not names:
        return documents.sparkSession.createDataFrame([], shape)
    params = train(documents, subject_labels, names)
    model = documents.sparkSession.sparkContext.broadcast((params["E"] @ params["W"], params["b"]))
    shown = [written[n] for n in names]

    def classify(batches):
        table, bias = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                rows, found = score(some.column("text").to_pylist(), table, bias)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(rows)), pa.array([shown[s] for s in found], pa.string())],
                    ["doc_id", "subject"],
                )

    return own.mapInArrow(classify, shape)


def subject_shares(found: DataFrame) -> DataFrame:
    """Documents on each subject."""
    return found.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
