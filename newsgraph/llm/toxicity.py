"""Toxicity by a linear-chain conditional random field over words.

A text is a chain of words (anything but white space), each tagged toxic or not. What a word
looks like is hashed into one table of weights: the word in lower case without marks around it,
its beginnings and endings, the words beside it, and whether it and its neighbours are written as a
sentence has them. Two tags, weights for their transitions, and forward-backward marginals
for each word.

Labels are given for documents, so tokens are labelled first: the same chain is fitted to "a
toxic document has one toxic word at least, a clean one has none", and the words that it
takes for toxic in toxic documents are the labelled tokens. The field is then fitted to these tokens.
Copies of one text (equal least hash of three words) share one document's weight. The
score of a document aggregates its marginals: the odds of at least one toxic word, the expected
number of them and that number per word go through a logistic calibration, fitted on marginals from
two halves of the sample that have each been tagged by a field fitted to the other, and
weighted to the shares of all labelled documents. Words above `SPAN` are the offending spans.

The fit uses a bounded sample of labelled texts: `sample_rows` of each label at most, in the order of
a hash of their ids, and `sample_bytes` of them. Scoring reads every whole text, shuffles
nothing, and computes the chain in blocks, so that a long text costs no more per word than short ones.

Defined results: null texts count as empty; texts without words have the score of a chain of
no words; without labelled rows of both kinds every score is 0.5; labels other than 0 and 1 are
passed over; a null id is held out of nothing and joins no label; repeated rows are scored once
each; an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fit sees at most so many texts of each label, and so many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 3 << 20
THRESHOLD, SPAN = 0.7, 0.5
#: Texts are tagged in pieces of a batch of about so many bytes.
CHUNK_BYTES = 2 << 20
#: Weights are kept in a table of 2^BITS places.
BITS = 20
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7), (3, 4)
KINDS = 1 + len(BEGINNINGS) + len(ENDINGS) + 2
SHAPES = 18
#: A place of the table gets a weight if toxic documents have it twice at least, in at least this share of them, and so many deviations more often than clean ones.
LEAST_SHARE, LEAST_SIGMA = 0.003, 3.0
#: The field is fitted to words with weights and so many words on both sides of them.
BESIDE = 3
STEPS, CHAIN_STEPS, RATE, RIDGE = 30, 15, 0.3, 0.1

_BYTES = np.arange(256)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~np.array([chr(b).isalnum() for b in range(256)])
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_STOP = np.isin(_BYTES, [ord(c) for c in ".!?"])


class Tokens:
    """The words of some texts: bytes, where each word begins and ends, its document, its hashes by kind and its shape."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        self.texts, self.buf = len(raw), np.frombuffer(b"\n".join(raw), np.uint8)
        self.first_byte = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
        self.starts, self.ends = common.word_bounds(self.buf)
        self.doc = np.searchsorted(self.first_byte, self.starts, "right") - 1
        self.sizes = np.bincount(self.doc, minlength=self.texts)
        self.opens = np.diff(self.doc, prepend=-1) != 0
        self.closes = np.diff(self.doc, append=-1) != 0
        self._look()

    def __len__(self) -> int:
        return len(self.starts)

    def chains(self, at: np.ndarray) -> Tokens:
        """The words at the given places; those that don't stand side by side are chains of their own."""
        part = object.__new__(Tokens)
        part.texts, part.starts, part.doc, part.shape = self.texts, self.starts[at], self.doc[at], self.shape[at]
        cut = np.diff(at, prepend=-2) != 1
        part.opens = self.opens[at] | cut
        part.closes = np.roll(part.opens, -1)
        part.closes[-1:] = True
        return part

    def _look(self) -> None:
        n, buf = len(self), self.buf
        if not n:
            self.hashes, self.shape, self.words = np.zeros((KINDS, 0), np.int32), np.zeros(0, np.int8), np.zeros(0, np.uint64)
            return
        core = np.flatnonzero(~_MARK[buf] & (buf > 32))
        if len(core):
            s, e = core[np.minimum(np.searchsorted(core, self.starts), len(core) - 1)], core[np.searchsorted(core, self.ends) - 1] + 1
            marks = (s >= self.ends) | (e <= self.starts) | (s >= e)  # words of marks alone stay as they are
            s, e = np.where(marks, self.starts, s), np.where(marks, self.ends, e)
        else:
            s, e = self.starts, self.ends
        low = _LOWER[buf]
        wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        upper = buf != low
        upper[wide - 1] = True
        low[wide] += 32
        spans = [(s, e), *[(s, np.minimum(s + k, e)) for k in BEGINNINGS], *[(np.maximum(e - k, s), e) for k in ENDINGS]]
        found = _span_hashes(low, spans, self.starts, self.ends)
        self.words = found[0]
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        before[1:], after[:-1] = found[0][:-1], found[0][1:]
        before[self.opens], after[self.closes] = 0, 0
        self.hashes = np.empty((KINDS, n), np.int32)
        for k, h in enumerate([*found, before, after]):
            self.hashes[k] = common.mix(h ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)) >> np.uint64(64 - BITS)
        case = np.where(upper[s], 1, np.where(_MARK[buf[s]], 2, 0)).astype(np.int8)
        stopped = np.ones(n, bool)
        stopped[1:] = _STOP[buf[self.ends[:-1] - 1]]
        stopped[self.opens] = True
        following = np.full(n, 2, np.int8)
        following[:-1] = case[1:]
        following[self.closes] = 2
        self.shape = case * 6 + stopped * 3 + following

    def families(self) -> np.ndarray:
        """Per text the least hash of three words in a row: copies, also near ones, mostly share it."""
        least = np.full(self.texts, np.uint64(2**64 - 1))
        h = common.rolled(self.words, 3)
        if len(h):
            within = self.doc[: len(h)] == self.doc[2:]
            np.minimum.at(least, self.doc[: len(h)][within], common.mix(h[within]))
        alone = least == np.uint64(2**64 - 1)
        least[alone] = np.arange(alone.sum(), dtype=np.uint64)
        return least


def _span_hashes(buf: np.ndarray, spans: list, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Hashes of the bytes of each span (inside its word), the same wherever it stands."""
    out = np.empty((len(spans), len(starts)), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + piece)))
        base, stop = int(starts[first]), int(ends[last - 1])
        up, down = common._power(stop - base)
        with np.errstate(over="ignore"):
            total = np.empty(stop - base + 1, np.uint64)
            total[0] = 0
            np.cumsum(common._BYTE[buf[base:stop]] * up[: stop - base], out=total[1:])
            for k, (s, e) in enumerate(spans):
                s, e = s[first:last] - base, e[first:last] - base
                out[k, first:last] = (total[e] - total[s]) * down[s]
        first = last
    return common.mix(out)


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[i] = (a[i] + b[i] r[i-1]) / (c[i] + d[i] r[i-1]) from r[-1] = 0, in about sqrt(n) steps over whole columns.

    The steps of a block are one such fraction of what goes into it, so blocks are joined by theirs and then gone through
    again side by side.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)

    def columns(x: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(rows * width, fill)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(rows, width).T)

    a, b, c, d = columns(a, 0.0), columns(b, 1.0), columns(c, 1.0), columns(d, 0.0)
    p, q, u, v = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)  # r = (p + q r0) / (u + v r0)
    for j in range(width):
        p, q, u, v = a[j] * u + b[j] * p, a[j] * v + b[j] * q, c[j] * u + d[j] * p, c[j] * v + d[j] * q
        top = np.maximum(np.maximum(p, q), np.maximum(u, v))
        p, q, u, v = p / top, q / top, u / top, v / top
    into, r = np.zeros(rows), 0.0
    for k in range(rows):
        into[k] = r
        r = (p[k] + q[k] * r) / max(u[k] + v[k] * r, 1e-300)
    out, r = np.empty((width, rows)), into
    for j in range(width):
        r = np.minimum((a[j] + b[j] * r) / (c[j] + d[j] * r), 1e150)
        out[j] = r
    return np.ascontiguousarray(out.T).ravel()[:n]


def chain(tokens: Tokens, z: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of the toxic tag, and r, q, e) by forward-backward. z: log odds of each word by itself.

    turns: log weights of clean to toxic, toxic to clean, toxic to toxic, and of beginning toxic; clean to clean weighs 1.
    """
    t01, t10, t11, start = np.exp(turns)
    e = np.exp(np.clip(z, -30, 30))
    one, none = np.ones(len(e)), np.zeros(len(e))
    r = scan(e * np.where(tokens.opens, start, t01), np.where(tokens.opens, 0.0, e * t11), one, np.where(tokens.opens, 0.0, t10))
    after = np.roll(e, -1)
    back = lambda x: np.ascontiguousarray(x[::-1])
    q = back(scan(back(np.where(tokens.closes, 1.0, t10)), back(np.where(tokens.closes, 0.0, t11 * after)), one, back(np.where(tokens.closes, none, t01 * after))))
    return r * q / (1 + r * q), r, q, e


def _log_clean(tokens: Tokens, r: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Log probability per text that none of its words is toxic."""
    step = np.where(tokens.opens, 0.0, np.log1p(np.exp(turns[1]) * np.roll(r, 1)))
    step += np.where(tokens.closes, np.log1p(r), 0.0)
    return -np.bincount(tokens.doc, step, tokens.texts)


class Field:
    """A fitted field: places of the table with their weights, weights of shapes, a bias, log weights of transitions."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, shapes: np.ndarray, bias: float, turns: np.ndarray) -> None:
        self.places, self.weights, self.shapes, self.bias, self.turns = places, weights, shapes, bias, turns
        self.calibration = self.centre = self.scale = None
        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def odds(self, tokens: Tokens) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.places] = self.weights
        z = self.shapes[tokens.shape] + self.bias
        for h in tokens.hashes:
            z += self._table[h]
        return z

    def tag(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of each word, what is aggregated of each text)."""
        p, r, _, _ = chain(tokens, self.odds(tokens), self.turns)
        expected = np.bincount(tokens.doc, p, tokens.texts)
        some = -_log_clean(tokens, r, self.turns)
        return p, np.c_[np.log(np.expm1(np.clip(some, 1e-9, 30))), np.log(expected + 1e-3), np.log((expected + 0.01) / (tokens.sizes + 10))]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[(features - self.centre) / self.scale, np.ones(len(features))]
        return 1 / (1 + np.exp(-np.clip(z @ self.calibration, -40, 40)))


def _places(tokens: Tokens, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the table that toxic documents have more often than clean ones, by more than chance. Copies count as one."""
    doc_toxic = toxic[tokens.doc]
    families = np.unique(tokens.families(), return_inverse=True)[1]
    share, clean_share = max(1, len(np.unique(families[toxic]))), max(1.0, weight[~toxic].sum())
    of_family, of_weight = families[tokens.doc[doc_toxic]].astype(np.int64), weight[tokens.doc[~doc_toxic]]
    kept = np.zeros(1 << BITS, bool)
    for h in tokens.hashes:
        pairs = np.unique((of_family << BITS) | h[doc_toxic])
        has = np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        clean = np.bincount(h[~doc_toxic], of_weight, 1 << BITS) * (share / clean_share)
        kept |= (has >= max(2, LEAST_SHARE * share)) & (has - clean >= LEAST_SIGMA * np.sqrt(clean + 0.3))
    return np.flatnonzero(kept)


def _descend(params: np.ndarray, slope, steps: int) -> np.ndarray:
    """Steps of one size for every weight, by running means and squares of its slope."""
    m, v = np.zeros(len(params)), np.zeros(len(params))
    for k in range(1, steps + 1):
        g = slope(params)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-3)
    return params


def _fit_field(tokens: Tokens, toxic: np.ndarray, weight: np.ndarray) -> Field:
    """toxic and weight: of each text."""
    places = _places(tokens, toxic, weight)
    number = np.zeros(1 << BITS, np.int32)
    number[places] = np.arange(1, len(places) + 1)
    numbered = number[tokens.hashes]  # 0: no weight
    active = np.flatnonzero(numbered.any(axis=0))
    ids, size = numbered[:, active], len(places) + 1
    del numbered
    doc, shape = tokens.doc[active], tokens.shape[active]
    # words without weights differ by their shape alone: they are counted per text and shape
    plain = np.ones(len(tokens), bool)
    plain[active] = False
    plain = np.bincount(tokens.doc[plain] * SHAPES + tokens.shape[plain], minlength=tokens.texts * SHAPES).reshape(-1, SHAPES)
    params = np.zeros(size + SHAPES + 1)
    params[-1] = -np.log(max(2.0, len(tokens) / max(1, tokens.texts))) - 1

    def slopes(g: np.ndarray, ids: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = np.zeros(size + SHAPES + 1)
        out[:size] = np.bincount(ids.ravel(), np.broadcast_to(g, ids.shape).ravel(), size)
        out[0] = 0
        out[size : size + SHAPES] = np.bincount(shape, g, SHAPES)
        out[-1] = g.sum()
        return out

    def some_or_none(params: np.ndarray) -> np.ndarray:
        """Toxic texts have some toxic word, clean ones none; each word by itself."""
        shapes = params[size : size + SHAPES]
        e, e_plain = np.exp(np.clip(params[ids].sum(axis=0) + shapes[shape] + params[-1], -30, 30)), np.exp(np.clip(shapes + params[-1], -30, 30))
        log_clean = -np.bincount(doc, np.log1p(e), tokens.texts) - plain @ np.log1p(e_plain)
        log_clean = np.minimum(log_clean, -1e-6)
        push = np.where(toxic, -np.exp(log_clean) / -np.expm1(log_clean), 1.0) * weight
        g = slopes(push[doc] * e / (1 + e), ids, shape)
        g_plain = (push @ plain) * e_plain / (1 + e_plain)
        g[size : size + SHAPES] += g_plain
        g[-1] += g_plain.sum()
        g[:-1] += RIDGE * params[:-1]
        return g

    params = _descend(params, some_or_none, STEPS)
    z = params[ids].sum(axis=0) + params[size : size + SHAPES][shape] + params[-1]
    y = np.zeros(len(tokens))
    y[active[toxic[doc] & (z >= np.log(SPAN / (1 - SPAN)))]] = 1
    told = np.bincount(tokens.doc[y > 0], minlength=tokens.texts) > 0
    # the field is fitted to chains of words with weights and those beside them; texts that are toxic by no word that can be told say nothing
    near = np.zeros(len(tokens) + 2 * BESIDE, bool)
    for k in range(2 * BESIDE + 1):
        near[active + k] = True
    within = np.flatnonzero(near[BESIDE : len(tokens) + BESIDE] & (told | ~toxic)[tokens.doc])
    part = tokens.chains(within)
    number = np.zeros(len(tokens), np.int64)
    number[active] = np.arange(len(active))
    lively = np.flatnonzero(np.isin(within, active))
    ids, shape, y, w = ids[:, number[within[lively]]], part.shape, y[within], weight[tokens.doc[within]]
    inner = np.flatnonzero(~part.opens)
    before, here, w_inner = y[inner - 1], y[inner], w[inner]
    seen = np.array([((1 - before) * here * w_inner).sum(), (before * (1 - here) * w_inner).sum(), (before * here * w_inner).sum(), (y * w)[part.opens].sum()])

    def of_tokens(both: np.ndarray) -> np.ndarray:
        """The likelihood of the labelled tokens, with transitions."""
        params, turns = both[:-4], both[-4:]
        t01, t10, t11, _ = np.exp(turns)
        z = params[size : size + SHAPES][shape] + params[-1]
        z[lively] += params[ids].sum(axis=0)
        p, r, q, e = chain(part, z, turns)
        r, eq = r[inner - 1], (e * q)[inner]
        total = 1 + t10 * r + (t01 + t11 * r) * eq
        met = np.array([(w_inner * t01 * eq / total).sum(), (w_inner * t10 * r / total).sum(), (w_inner * t11 * r * eq / total).sum(), (p * w)[part.opens].sum()])
        off = (p - y) * w
        g = slopes(off[lively], ids, shape[lively])
        g[size : size + SHAPES], g[-1] = np.bincount(shape, off, SHAPES), off.sum()
        g[:-1] += RIDGE * params[:-1]
        return np.concatenate([g, met - seen + RIDGE * turns])

    both = _descend(np.concatenate([params, np.zeros(4)]), of_tokens, CHAIN_STEPS)
    params, turns = both[:-4], both[-4:]
    large = np.abs(params[1:size]) > 1e-3
    return Field(places[large], params[1:size][large].astype(np.float32), params[size : size + SHAPES], float(params[-1]), turns)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[(x - centre) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = 0.05 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * (p * (1 - p) + 1e-9))) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def fit_texts(toxic: list[str], clean: list[str], shares: tuple[float, float] = (1.0, 1.0)) -> Field | None:
    """shares: labelled documents of all that each text of the two lists stands for."""
    if not toxic or not clean:
        return None
    texts, y = [*toxic, *clean], np.repeat([True, False], [len(toxic), len(clean)])
    tokens = Tokens(texts)
    families = tokens.families()
    _, number, count = np.unique(families, return_inverse=True, return_counts=True)
    weight = 1.0 / count[number]
    field = _fit_field(tokens, y, weight)
    # copies go to one half; each half is tagged by the other's field
    half = (common.mix(families) & np.uint64(1)).astype(bool)
    features = field.tag(tokens)[1]
    for side in (half, ~half):
        if y[~side].any() and (~y[~side]).any() and side.any():
            there, here = np.flatnonzero(~side), np.flatnonzero(side)
            other = _fit_field(Tokens([texts[i] for i in there]), y[there], weight[there])
            features[here] = other.tag(Tokens([texts[i] for i in here]))[1]
    field.calibration, field.centre, field.scale = _logistic(features, y.astype(float), weight * np.where(y, *shares))
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Field | None:
    """A field from labelled rows that aren't held out. labels has id_col and label_col."""
    sample, counts = common.labelled_sample(docs, labels, held_out, id_col, text_col, label_col, sample_rows, sample_bytes)
    shares = tuple(counts[k] / max(1, len(sample[k])) for k in (1, 0))
    return fit_texts(sample[1], sample[0], shares)


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, span: float = SPAN) -> DataFrame:
    """For each row: doc_id, held_out, score (0 to 1), predicted (1: toxic), spans (start and end in code points of runs of toxic words)."""
    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"

    def run(batches):
        import pyarrow as pa

        for chunk in common.chunks(batches, "text", CHUNK_BYTES):
            n, scores, spans = chunk.num_rows, np.full(chunk.num_rows, 0.5), [[] for _ in range(chunk.num_rows)]
            if field:
                tokens = Tokens(chunk["text"].to_pylist())
                p, features = field.tag(tokens)
                scores = field.scores(features)
                for doc, start, end in offsets(tokens, p >= span):
                    spans[doc].append({"start": start, "end": end})
            yield pa.record_batch({"doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= threshold).astype(np.int32)), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    picked = common.take(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return picked.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, schema)


def offsets(tokens: Tokens, toxic: np.ndarray):
    """(text, start, end) in code points for each run of words that are marked."""
    first = np.flatnonzero(toxic & (np.roll(~toxic, 1) | tokens.opens))
    last = np.flatnonzero(toxic & (np.roll(~toxic, -1) | tokens.closes))
    if not len(first):
        return
    points = np.concatenate([[0], np.cumsum((tokens.buf & 0xC0) != 0x80)])
    at = points[tokens.first_byte[tokens.doc[first]]]
    yield from zip(tokens.doc[first].tolist(), (points[tokens.starts[first]] - at).tolist(), (points[tokens.ends[last]] - at).tolist(), strict=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
