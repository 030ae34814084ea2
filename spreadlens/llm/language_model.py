"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, over exact corpus counts.

Tokens are words with A-Z in lower case, then one end. Counts: every block of documents sends its distinct words, each
once, to the owners of the words; an owner adds up the training counts and answers with one total for each word sent.
In which documents the words stand stays in a row of the block, which meets the answers and makes sums per document. So
what is sent follows the blocks' distinct words, whatever the number of owners, and a block's step holds one block.
The model's vocabulary is the ``CLASSES - 2`` most frequent training words, the end, and one class for all other words,
inside which a word has its add-one share; so the probabilities of all words sum to 1.
The model predicts a class from the two before: score = q_w . (c1 * r_u + c2 * r_v) + b_w. The class triples of all
training documents are counted and dealt to parts by a hash, one part for ``OWNER_BYTES`` of text; a part trains on its
triples in numpy, a set of noise classes shared by a batch, and the parts' parameters are averaged by their tokens. So
scores do not depend on how the rows are spread over tasks. Scoring computes each block's distinct contexts by matrix products with
a full softmax, and looks every token up.

A document trains unless crc32(id as text) mod ``FOLDS`` is ``HELD_OUT``; a null id counts as an empty one. Null and
empty texts have one token, the end. Repeated rows are scored and counted row by row. Words are compared by 64-bit
hashes. Texts are never cut. An empty table gives an empty result; further columns are left alone.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed
from .text_arrays import U, mix, slices, text_bytes, words_of

FOLDS, HELD_OUT = 7, 2
CLASSES, WIDTH, NOISE, BATCH, RATE = 512, 24, 64, 1024, 0.1
#: Every part passes over its triples until it has made so many updates, once at least.
UPDATES = 400
CONTEXTS = 4096
OTHER, END, START = 0, 1, CLASSES
END_WORD = U(0x454E44)
#: A block ends after so many rows or bytes of text; one longer text is a block.
BLOCK_ROWS, BLOCK_BYTES = 4000, 8 << 20
OWNER_BYTES = 16 << 20
#: A task that holds so many class triples adds up equal ones; if half of them differ, it sends them.
TRIPLES = 1 << 20


def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS == HELD_OUT


def blocks(batches: Iterator[pa.RecordBatch]):
    """(name, ids, training flags, words with an end after each text, places of the texts, fingerprints)."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    k = 0
    for batch in batches:
        data, starts = text_bytes(batch.column("text"))
        first = 0
        while first < batch.num_rows:
            last = min(batch.num_rows, first + BLOCK_ROWS, max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK_BYTES, side="right")) - 1))
            offsets = starts[first:last + 1]
            parts, sizes, prints = [], [], []
            for i, j in slices(offsets):
                words, where = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for r in range(j - i):
                    w = words[where[r]:where[r + 1]]
                    parts += [w, END_WORD[None]]
                    sizes.append(len(w) + 1)
                    prints.append(int(mix(np.array([(w * np.arange(1, 2 * len(w), 2, dtype=np.uint64)).sum(dtype=np.uint64) + U(len(w))]))[0]))
            ids = batch.column("id").slice(first, last - first).to_pylist()
            train = np.array([not held_out(x) for x in ids], dtype=bool)
            words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield f"{task}-{k}", ids, train, words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(prints, dtype=np.uint64).view(np.int64)
            k += 1
            first = last


SENT = "owner int, block string, words binary, counts binary, entries binary, places binary, times binary, ids array<bigint>, prints array<bigint>"


def _send(owners: int):
    """To owners: words and training counts. Owner -1: a block's documents, and in which of them its words, in order, stand how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, train, words, at, prints in blocks(batches):
            n = len(ids)
            doc = np.repeat(np.arange(n), np.diff(at))
            distinct, code = np.unique(words, return_inverse=True)
            pair, times = np.unique(code.astype(np.int64) * n + doc, return_counts=True)
            word, place = pair // n, pair % n
            trained = np.bincount(word, times * train[place], minlength=len(distinct)).astype(np.uint32)
            entries = np.bincount(word, minlength=len(distinct)).astype(np.uint16)
            of = ((distinct >> U(32)) * U(owners)) >> U(32)
            cut = np.searchsorted(of, np.arange(owners + 1, dtype=np.uint64))
            to = np.flatnonzero(np.diff(cut))
            m = len(to)
            lists = pa.list_(pa.int64())
            own = {"entries": entries, "places": place.astype(np.uint16), "times": times.astype(np.uint32)}
            yield pa.RecordBatch.from_pydict({
                "owner": pa.array([*to, -1], pa.int32()), "block": pa.array([name] * (m + 1)),
                **{c: pa.array([x[cut[o]:cut[o + 1]].tobytes() for o in to] + [None], pa.binary()) for c, x in (("words", distinct), ("counts", trained))},
                **{c: pa.array([None] * m + [x.tobytes()], pa.binary()) for c, x in own.items()},
                "ids": pa.array([None] * m + [ids], lists), "prints": pa.array([None] * m + [prints], lists)})

    return run


ANSWER = "owner int, block string, totals binary, tokens bigint, kinds bigint, top array<struct<word:bigint,n:bigint>>"


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner: training counts of its words; to every block those of the words it sent."""
    words, counts = ([np.frombuffer(x, kind) for x in group[c]] for c, kind in (("words", np.uint64), ("counts", np.uint32)))
    distinct, code = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(code, np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    plain = np.flatnonzero(distinct != END_WORD)
    best = np.concatenate([plain[np.lexsort((distinct[plain], -total[plain]))[:CLASSES - 2]], np.flatnonzero(distinct == END_WORD)])
    top = [{"word": int(w), "n": int(c)} for w, c in zip(distinct[best].view(np.int64), total[best]) if c and distinct[best].size]
    totals = [total[code[end - len(w):end]].tobytes() for w, end in zip(words, ends)]
    out = pd.DataFrame({"owner": group["owner"].to_numpy(), "block": group["block"].to_numpy(), "totals": totals, "tokens": 0, "kinds": 0, "top": None})
    first = pd.DataFrame({"owner": [group["owner"].iloc[0]], "block": [""], "totals": None, "tokens": int(total.sum()), "kinds": int((total > 0).sum()), "top": [top]})
    return pd.concat([first, out], ignore_index=True)


def _totals(block: pa.Table) -> pa.Table:
    """A block's row and its answers: a row for each document, with the sum of log10(c + 1) and the number of known tokens."""
    owner = block.column("owner").to_numpy()
    (row,) = block.filter(pa.array(owner < 0)).select(["entries", "places", "times"]).to_pylist()
    ids, prints = (block.column(c).filter(pa.array(owner < 0)).combine_chunks().flatten() for c in ("ids", "prints"))
    answers = block.column("totals").to_pylist()
    total = np.concatenate([np.frombuffer(answers[k], np.int64) for k in np.argsort(owner) if owner[k] >= 0])
    word = np.repeat(np.arange(len(total)), np.frombuffer(row["entries"], np.uint16))
    places, times = np.frombuffer(row["places"], np.uint16), np.frombuffer(row["times"], np.uint32)
    logs = np.bincount(places, times * np.log10(total + 1.0)[word], minlength=len(ids))
    known = np.bincount(places, times * (total > 0)[word], minlength=len(ids)).astype(np.int64)
    return pa.table({"id": ids, "print": prints, "logs": logs, "known": known})


class Vocabulary:
    """Classes of the most frequent training words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, kinds: int):
        keep = words != END_WORD
        words, counts_ = words[keep][:CLASSES - 2], counts[keep][:CLASSES - 2]
        order = np.argsort(words)
        self.words, self.counts = words[order], counts_[order]
        self.tokens, self.kinds = tokens, kinds
        self.end = int(counts[~keep].sum())
        self.other = tokens - int(self.counts.sum()) - self.end
        #: what the shares of all other words are divided by: their counts plus one each, and one unseen word
        self.other_total = self.other + (kinds - len(self.words) - 1) + 1

    def classes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.where(words == END_WORD, END, OTHER)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(words == END_WORD, END, np.where(self.words[at] == words, at + 2, OTHER))

    def frequencies(self) -> np.ndarray:
        f = np.full(CLASSES, 0.5)
        f[OTHER] += self.other
        f[END] += self.end
        f[2:2 + len(self.counts)] += self.counts
        return f / f.sum()

    def logs(self) -> np.ndarray:
        """log10(c + 1) of the classes that are words."""
        out = np.zeros(CLASSES)
        out[END] = np.log10(self.end + 1)
        out[2:2 + len(self.counts)] = np.log10(self.counts + 1.0)
        return out


def contexts(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code of the two classes before every token; START before a text."""
    one, two = np.full(len(classes), START), np.full(len(classes), START)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    begin = at[:-1]
    one[begin] = two[begin] = START
    second = begin + 1
    two[second[second < at[1:]]] = START
    return two * (CLASSES + 1) + one


class LogBilinear:
    """Parameters, as one flat array: word vectors r, target vectors q, position weights c, biases b."""

    SHAPES = ((CLASSES + 1, WIDTH), (CLASSES, WIDTH), (2, WIDTH), (CLASSES,))

    def __init__(self, flat: np.ndarray):
        self.flat, self.parts, i = flat, [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(flat[i:i + n].reshape(shape))
            i += n

    @classmethod
    def fresh(cls, frequencies: np.ndarray) -> LogBilinear:
        rng = np.random.Generator(np.random.PCG64(3))
        sizes = [int(np.prod(s)) for s in cls.SHAPES]
        model = cls(np.concatenate([rng.normal(0, 0.1, sizes[0] + sizes[1]), np.ones(sizes[2]), np.log(frequencies)]))
        return model

    def train(self, codes: np.ndarray, counts: np.ndarray, frequencies: np.ndarray, seed: int) -> None:
        """Noise-contrastive estimation over all class triples weighted by their counts, in batches."""
        r, q, c, b = self.parts
        power = LogBilinear(np.full(len(self.flat), 1e-2))
        rng = np.random.Generator(np.random.PCG64(seed))
        passes = -(-UPDATES // -(-len(codes) // BATCH))
        order = np.concatenate([rng.permutation(len(codes)) for _ in range(passes)])
        shift = np.log(NOISE * frequencies)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for i in range(0, len(order), BATCH):
            k = order[i:i + BATCH]
            context, target = codes[k] // CLASSES, codes[k] % CLASSES
            u, v, weight = context // (CLASSES + 1), context % (CLASSES + 1), counts[k] / counts[k].mean()
            weight = weight / len(k)
            h = c[0] * r[u] + c[1] * r[v]
            noise = rng.choice(CLASSES, NOISE, p=frequencies)
            g = (sig((h * q[target]).sum(axis=1) + b[target] - shift[target]) - 1) * weight
            e = sig(h @ q[noise].T + b[noise] - shift[noise]) * weight[:, None]
            dh = g[:, None] * q[target] + e @ q[noise]
            grad = LogBilinear(np.zeros(len(self.flat)))
            dr, dq, dc, db = grad.parts
            for n in range(WIDTH):
                dq[:, n] = np.bincount(target, g * h[:, n], minlength=CLASSES)
                dr[:, n] = np.bincount(u, dh[:, n] * c[0, n], minlength=CLASSES + 1) + np.bincount(v, dh[:, n] * c[1, n], minlength=CLASSES + 1)
            np.add.at(dq, noise, e.T @ h)
            db += np.bincount(target, g, minlength=CLASSES)
            np.add.at(db, noise, e.sum(axis=0))
            dc[0], dc[1] = (dh * r[u]).sum(axis=0), (dh * r[v]).sum(axis=0)
            power.flat += grad.flat**2 * len(k)
            self.flat -= RATE * grad.flat * len(k)**0.5 / np.sqrt(power.flat)

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the targets after the contexts."""
        r, q, c, b = self.parts
        distinct, of = np.unique(context, return_inverse=True)
        order = np.argsort(of, kind="stable")
        out, ends = np.empty(len(context)), np.searchsorted(of[order], np.arange(0, len(distinct) + CONTEXTS, CONTEXTS))
        for i, lo, hi in zip(range(0, len(distinct), CONTEXTS), ends, ends[1:]):
            k = distinct[i:i + CONTEXTS]
            s = (c[0] * r[k // (CLASSES + 1)] + c[1] * r[k % (CLASSES + 1)]) @ q.T + b
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            rows = order[lo:hi]
            out[rows] = s[of[rows] - i, target[rows]]
        return out / np.log(10)


def _triples(vocabulary: Vocabulary, parts: int):
    """Of every task: its class triples with their counts, dealt to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, _, train, words, at, _ in blocks(batches):
            classes = vocabulary.classes(words)
            own = np.repeat(train, np.diff(at))
            held.append(np.unique((contexts(classes, at) * CLASSES + classes)[own], return_counts=True))
            if sum(len(x) for x, _ in held) > TRIPLES:
                held = [added(held)]
                if len(held[0][0]) > TRIPLES // 2:
                    yield from sent(*held.pop())
        if held:
            yield from sent(*added(held))

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        x, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return x, np.bincount(of, np.concatenate([n for _, n in held]), minlength=len(x)).astype(np.int64)

    def sent(x: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = ((mix(x.astype(np.uint64)) >> U(32)) * U(parts)) >> U(32)
        order = np.argsort(part, kind="stable")
        to, at = np.unique(part[order], return_index=True)
        ends = [*at[1:], len(x)]
        if len(to):
            yield pa.RecordBatch.from_pydict({"part": pa.array(to.astype(np.int32)), **{
                name: pa.array([v[order[i:j]].tobytes() for i, j in zip(at, ends)], pa.binary()) for name, v in (("codes", x), ("counts", n))}})

    return run


def _fit(vocabulary: Vocabulary):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes, counts = (np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("codes", "counts"))
        codes, of = np.unique(codes, return_inverse=True)
        n = np.bincount(of, counts)
        model = LogBilinear.fresh(vocabulary.frequencies())
        model.train(codes, n, vocabulary.frequencies(), int(group["part"].iloc[0]))
        return pd.DataFrame({"weight": [float(n.sum())], "flat": [(model.flat * n.sum()).tobytes()]})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, flat = 0.0, None
    for b in batches:
        for w, x in zip(b.column("weight").to_pylist(), b.column("flat").to_pylist()):
            weight, flat = weight + w, np.frombuffer(x) if flat is None else flat + np.frombuffer(x)
    if flat is not None:
        yield pa.RecordBatch.from_pydict({"weight": pa.array([weight]), "flat": pa.array([flat.tobytes()], pa.binary())})


def _score(vocabulary: Vocabulary, model: LogBilinear):
    logs = vocabulary.logs()
    parameters = model.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogBilinear(parameters)
        for _, ids, train, words, at, prints in blocks(batches):
            classes = vocabulary.classes(words)
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            add = lambda x: np.bincount(doc, x, minlength=len(ids))
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "print": pa.array(prints), "held_out": pa.array(~train), "n_tokens": pa.array(np.diff(at)),
                "others": pa.array(add(classes == OTHER).astype(np.int64)), "class_logs": pa.array(add(logs[classes])),
                "class_score": pa.array(add(own.log10(contexts(classes, at), classes)))})

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES))
    sent = checkpointed(own.mapInArrow(_send(owners), SENT))
    answers = checkpointed(sent.filter("owner >= 0").select("owner", "block", "words", "counts").groupBy("owner").applyInPandas(_answer, ANSWER))
    totals = answers.filter("block = ''").agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    best = answers.filter("block = ''").select(F.explode("top").alias("t")).select("t.*")
    end = F.col("word") == int(END_WORD)
    top = best.filter(~end).orderBy(F.desc("n"), "word").limit(CLASSES - 2).collect() + best.filter(end).collect()
    tokens, kinds = totals["n"] or 0, totals["v"] or 0
    vocabulary = Vocabulary(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in top], dtype=np.int64), tokens, kinds)

    parts = max(1, -(-size // OWNER_BYTES))
    triples = own.mapInArrow(_triples(vocabulary, parts), "part int, codes binary, counts binary")
    fitted = checkpointed(triples.groupBy("part").applyInPandas(_fit(vocabulary), "weight double, flat binary"))
    sums = fitted.repartition(64).mapInArrow(_added, "weight double, flat binary").collect()
    model = LogBilinear(sum(np.frombuffer(r["flat"]) for r in sums) / sum(r["weight"] for r in sums)) if sums else LogBilinear.fresh(vocabulary.frequencies())

    rows = sent.filter("owner < 0").drop("words", "counts")
    gathered = rows.unionByName(answers.filter("totals is not null").select("owner", "block", "totals"), allowMissingColumns=True)
    logs = gathered.groupBy("block").applyInArrow(_totals, "id bigint, print bigint, logs double, known bigint")
    logs = logs.groupBy("id", "print").agg(F.first("logs").alias("logs"), F.first("known").alias("known"))
    scored = own.mapInArrow(_score(vocabulary, model), "id bigint, print bigint, held_out boolean, n_tokens bigint, others bigint, class_logs double, class_score double")
    both = scored.alias("s").join(logs.alias("l"), F.col("s.id").eqNullSafe(F.col("l.id")) & (F.col("s.print") == F.col("l.print")))
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))
    inside = F.col("logs") - F.col("class_logs") - F.col("others") * F.lit(float(np.log10(max(1, vocabulary.other_total))))
    return both.select("s.id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
                       base.alias("base_score"), (F.col("class_score") + inside).alias("score"))
