"""Languages of documents and of the stretches inside them.

Texts are cut into pieces: whole sentences, and the fragments between or after them (titles,
cut-off lines, short cries). A piece gets its language in two steps: a set
of one-versus-one linear support vector machines chooses the language family,
a second set the language within the family. Both are trained here, on a bounded
sample of the rows' own labels; since labels may be wrong, sentences whose label is
contradicted by models of other documents are left out of the last fit.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import folded

# Two-letter code, three-letter codes, English name, family.
LANGUAGES = [
    ("en", "eng", "english", "germanic"), ("de", "deu ger", "german", "germanic"), ("nl", "nld dut", "dutch", "germanic"),
    ("sv", "swe", "swedish", "germanic"), ("da", "dan", "danish", "germanic"), ("no", "nor nob nno nb nn", "norwegian", "germanic"),
    ("is", "isl ice", "icelandic", "germanic"), ("af", "afr", "afrikaans", "germanic"),
    ("fr", "fra fre", "french", "romance"), ("es", "spa", "spanish", "romance"), ("pt", "por", "portuguese", "romance"),
    ("it", "ita", "italian", "romance"), ("ro", "ron rum", "romanian", "romance"), ("ca", "cat", "catalan", "romance"),
    ("gl", "glg", "galician", "romance"), ("cs", "ces cze", "czech", "slavic"), ("sk", "slk slo", "slovak", "slavic"),
    ("pl", "pol", "polish", "slavic"), ("ru", "rus", "russian", "slavic"), ("uk", "ukr", "ukrainian", "slavic"),
    ("be", "bel", "belarusian", "slavic"), ("bg", "bul", "bulgarian", "slavic"), ("sr", "srp", "serbian", "slavic"),
    ("hr", "hrv", "croatian", "slavic"), ("sl", "slv", "slovenian", "slavic"), ("fi", "fin", "finnish", "uralic"),
    ("et", "est", "estonian", "uralic"), ("hu", "hun", "hungarian", "uralic"), ("lt", "lit", "lithuanian", "baltic"),
    ("lv", "lav", "latvian", "baltic"), ("el", "ell gre", "greek", "hellenic"), ("tr", "tur", "turkish", "turkic"),
    ("ar", "ara", "arabic", "semitic"), ("he", "heb", "hebrew", "semitic"), ("fa", "fas per", "persian", "iranian"),
    ("hi", "hin", "hindi", "indic"), ("ja", "jpn", "japanese", "japonic"), ("zh", "zho chi", "chinese", "sinitic"),
    ("ko", "kor", "korean", "koreanic"), ("vi", "vie", "vietnamese", "austroasiatic"), ("th", "tha", "thai", "tai"),
    ("id", "ind", "indonesian", "malayic"), ("ms", "msa may", "malay", "malayic"),
]
FAMILY = {code: family for code, _, _, family in LANGUAGES}

#: Bounds of the training sample: labelled documents, and sentences of them, per label.
DOCS_PER_LABEL = 400
SENTENCES_PER_LABEL = 250
DIMENSIONS = 4_096
ORDERS = (1, 2, 3, 4)
SENTENCES_PER_DOCUMENT = 3
#: Strengths of the regularisation, against the mean squared length of a text's features: of the fits that judge labels, and of the last.
JUDGING_RIDGES = (1.0, 0.3, 0.3)
RIDGE = 0.02
SENTENCE_CHARS = 1_000
FOLDS = 3
#: Steepness of the confidence in the margin.
SLOPE = 4.0
#: A sentence counts as one of its language only with as many words, or as many letters in scripts without spaces.
LEAST_WORDS = 4
LEAST_LETTERS = 8
#: Characters hashed in one NumPy step.
STEP_CHARS = 150_000

# Sentence ends. Latin and related; full-width; Indic; Arabic and Urdu; the Greek question mark; the end of a line of Thai or Lao.
END = re.compile(
    r"[.!?…]+[\"”»’'“)\]*_]*(?=\s|$)|[。！？]+[”」』)]*|[।॥]+|[؟۔]+|(?:\u037e|(?<=[\u0370-\u03ff\u1f00-\u1fff]);)(?=\s|$)|(?<=[\u0e00-\u0eff])\s*(?:\n|$)"
)
#: Letters of scripts without spaces.
_UNSPACED = r"\u0e00-\u0eff\u3005\u3040-\u30ff\u3400-\u9fff\uff66-\uff9f"
# Tokens that spaces alone would end are ASCII or end at such a letter; a tag of these letters must stand alone.
NOISE = re.compile(
    rf"https?://[^\s{_UNSPACED}]+|www\.[^\s{_UNSPACED}]+|<[^<>]{{1,200}}>|\[\d+:\d+\]"
    rf"|[@#](?:[^\s{_UNSPACED}]+|[{_UNSPACED}]{{1,20}}(?=[\s@#]|$))|[!-~]*[0-9][!-~]{{20,}}"
    r"|[\"“«„(][^\"“”»„().!?。]{1,80}[\"”»“)]"
)
#: What a text must contain for NOISE to match.
MAYBE_NOISE = re.compile(r"[<\[@#\"“«„(0-9]|https?:|www\.")
UNSPACED = re.compile(rf"[{_UNSPACED}]")
# Letters without a canonical decomposition.
PLAIN = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def label_code(lang: Column) -> Column:
    """The two-letter code a label names (code, code with region, three-letter code or English name), else null."""
    names = {n: code for code, three, name, _ in LANGUAGES for n in (code, *three.split(), name)}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.regexp_extract(folded(lang), r"^[a-z]+", 0))


class _Plain(dict):
    """Code point to plain letters: lower case without accents, what is neither letter nor mark as a space."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code).casefold().translate(PLAIN))
        kept = [c if unicodedata.category(c)[0] in "LM" else " " for c in parts if c not in "\u3099\u309a" and not "\u0300" <= c <= "\u036f"]
        self[code] = "".join(kept)
        return self[code]


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Lower-case letters without accents, other runs as one space; marks that are vowels or tones of their script stay."""
    return " ".join(text.translate(_PLAIN).split())


def pieces(text: str, known: dict[str, str] | None = None) -> list[tuple[int, int, str, bool]]:
    """(start, end, plain letters, whole) of all parts of a text that have letters.

    A whole sentence ends with a sentence mark of its script and has LEAST_WORDS words or LEAST_LETTERS letters of a
    script without spaces; everything else is a fragment. Links, mentions, hashtags, markup
    and short quoted or bracketed phrases are taken out before it is judged. ``known`` remembers the letters of
    parts seen before.
    """
    out, at = [], 0
    known = {} if known is None else known
    ends = [m.end() for m in END.finditer(text)]
    closed = len(ends)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for k, end in enumerate(ends):
        start, at = at, end
        raw = text[start:end]
        letters = known.get(raw)
        if letters is None:
            clear = html.unescape(raw) if "&" in raw else raw
            letters = known[raw] = plain(NOISE.sub(" ", clear) if MAYBE_NOISE.search(clear) else clear)
        if letters:
            enough = letters.count(" ") + 1 >= LEAST_WORDS or len(UNSPACED.findall(letters)) >= LEAST_LETTERS
            out.append((start, end, letters, enough and k < closed))
    return out


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, plain letters) of the whole sentences of a text."""
    return [p[:3] for p in pieces(text) if p[3]]


def _hashed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of character n-grams (text number, feature) of every n-gram, in text order."""
    joined = "\n".join(f" {t} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 10)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            k = len(codes) - n + 1
            if k <= 0:
                break
            h = h[:k] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            ok = owner[:k] == owner[n - 1 :]
            ok &= (codes[:k] != 10) & (codes[n - 1 :] != 10)
            mixed = (h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            out.append((owner[:k][ok], (mixed[ok] >> np.uint64(40)).astype(np.int64) % DIMENSIONS))
    return out


def matrix(texts: list[str]) -> np.ndarray:
    """Relative n-gram frequencies, one row per text."""
    rows, cols = (np.concatenate(x) for x in zip(*_hashed(texts)))
    x = np.bincount(rows * DIMENSIONS + cols, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(np.float32)
    return x / np.maximum(1, x.sum(1, keepdims=True))


def _machine(kernel: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Dual weights of a linear support vector machine with squared hinge loss.

    Newton steps on the active set: the rows inside the margin solve
    (K + ridge / share) alpha = y, where each side has half of the total weight.
    ``kernel`` includes the bias as a constant.
    """
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    active, alpha = np.ones(len(y), dtype=bool), np.zeros(len(y))
    for _ in range(20):
        k = kernel[np.ix_(active, active)].astype(np.float64)
        k[np.diag_indices_from(k)] += ridge / share[active]
        alpha = np.zeros(len(y))
        alpha[active] = np.linalg.solve(k, y[active])
        inside = y * (kernel[:, active] @ alpha[active]) < 1
        if (inside == active).all() or not inside.any():
            break
        active = inside
    return alpha


class Duel:
    """One-versus-one machines between names: weights (features, pairs), biases and the slope of confidence."""

    def __init__(self, names: list[str], x: np.ndarray, kernel: np.ndarray, y: np.ndarray, ridge: float):
        self.names = names
        self.pairs = list(combinations(range(len(names)), 2))
        self.weights = np.zeros((x.shape[1], len(self.pairs)), dtype=np.float32)
        self.bias = np.zeros(len(self.pairs), dtype=np.float32)
        ridge *= float(np.trace(kernel)) / max(1, len(kernel))
        for k, (a, b) in enumerate(self.pairs):
            rows = np.flatnonzero((y == a) | (y == b))
            side = np.where(y[rows] == a, 1.0, -1.0)
            alpha = _machine(kernel[np.ix_(rows, rows)], side, ridge)
            self.weights[:, k] = x[rows].T @ alpha.astype(np.float32)
            self.bias[k] = alpha.sum()

    def judge(self, grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(name number, confidence) of each of n texts from their n-grams, which come in text order."""
        if len(self.names) == 1:
            return np.zeros(n, dtype=int), np.ones(n)
        sums, size = np.zeros((n, len(self.pairs)), dtype=np.float32), np.zeros(n)
        for rows, cols in grams:
            if len(rows):
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                sums[rows[starts]] += np.add.reduceat(self.weights[cols], starts, axis=0)
                size += np.bincount(rows, minlength=n)
        return self._decide(sums / np.maximum(1, size)[:, None] + self.bias)

    def _decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-SLOPE * margin))
        votes = np.zeros((len(margin), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += p[:, k]
            votes[:, b] += 1 - p[:, k]
        best = votes.argmax(1)
        least = np.ones(len(margin))
        for k, (a, b) in enumerate(self.pairs):
            least = np.where(best == a, np.minimum(least, p[:, k]), np.where(best == b, np.minimum(least, 1 - p[:, k]), least))
        return best, least


class Model:
    """Family machines and, per family, language machines."""

    def __init__(self, x: np.ndarray, kernel: np.ndarray, langs: list[str], scale: np.ndarray, ridge: float):
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY[v] for v in self.langs})
        self.top = Duel(self.families, x, kernel, np.array([self.families.index(FAMILY[v]) for v in langs]), ridge)
        self.within = {}
        for f in self.families:
            members = [v for v in self.langs if FAMILY[v] == f]
            rows = np.array([i for i, v in enumerate(langs) if v in members])
            self.within[f] = Duel(members, x[rows], kernel[np.ix_(rows, rows)], np.array([members.index(langs[i]) for i in rows]), ridge)
        for duel in (self.top, *self.within.values()):
            duel.weights *= scale[:, None]

    @classmethod
    def train(cls, texts: list[str], langs: list[str], folds: np.ndarray) -> Model:
        """Leaves out the texts whose label is contradicted by models of the other folds, then fits.

        ``folds`` keeps texts of one document together, so a wrongly labelled
        document can't vouch for itself. The models that judge labels are strongly regularised
        first: they follow the majority of a label's texts. A text is taken as it is where the other
        folds have none of its label, and so is a label of which no text would be left.
        """
        x = matrix(texts)
        scale = (1 / np.sqrt(x.mean(0) + 1e-4)).astype(np.float32)
        x *= scale
        kernel, y = x @ x.T + 1, np.array(langs, dtype=object)
        keep = np.ones(len(texts), dtype=bool)

        def model(rows: np.ndarray, ridge: float) -> Model:
            return cls(x[rows], kernel[np.ix_(rows, rows)], list(y[rows]), scale, ridge)

        for ridge in JUDGING_RIDGES:
            found = y.copy()
            for fold in np.unique(folds):
                rest, mine = np.flatnonzero(keep & (folds != fold)), np.flatnonzero(folds == fold)
                mine = mine[np.isin(y[mine], y[rest])]
                if len(rest) and len(mine):
                    found[mine] = model(rest, ridge).predict([texts[i] for i in mine])[0]
            right = found == y
            keep = right | ~np.isin(y, y[right])
        return model(np.flatnonzero(keep) if keep.any() else np.arange(len(y)), RIDGE)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, confidence) of each text: the product of both steps' confidences."""
        langs: list[str] = []
        sure: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            chars, end = 0, at
            while end < len(texts) and (end == at or chars + len(texts[end]) <= STEP_CHARS):
                chars += len(texts[end])
                end += 1
            part = texts[at:end]
            grams = _hashed(part)
            family, p = self.top.judge(grams, len(part))
            named = np.empty(len(part), dtype=object)
            for k in np.unique(family):
                pick = family == k
                number = np.cumsum(pick) - 1
                duel = self.within[self.families[k]]
                mine = [(number[rows[pick[rows]]], cols[pick[rows]]) for rows, cols in grams] if len(duel.names) > 1 else []
                lang, q = duel.judge(mine, int(pick.sum()))
                named[pick] = np.array(duel.names, dtype=object)[lang]
                p[pick] *= q
            langs.extend(named)
            sure.append(p)
            at = end
        return langs, np.concatenate(sure) if sure else np.empty(0)


def fit(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL, per_label: int = SENTENCES_PER_LABEL) -> Model | None:
    """A model from the labels of ``docs`` (doc_id, text, lang); None if no label names a language of a sentence.

    At most ``docs_per_label`` documents of each label, those with the smallest
    hash of their id, give at most SENTENCES_PER_DOCUMENT sentences each, of which
    at most ``per_label`` come to the driver (each cut at SENTENCE_CHARS):
    some 43 labels at most, whatever the number of documents. At 43 full labels the driver holds
    10,750 sentences, their features (180 MB) and products (460 MB).
    """
    labelled = docs.select("text", "doc_id", label_code(F.col("lang")).alias("code")).where("code is not null and text is not null")
    by = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = labelled.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= docs_per_label).select("doc_id", "text", "code")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, c in zip(b["doc_id"], b["text"], b["code"]):
                own = sorted({s for _, _, s in sentences(t)}, key=lambda s: (zlib.crc32(s.encode()), s))
                rows += [(d, k, s[:SENTENCE_CHARS], c) for k, s in enumerate(own[:SENTENCES_PER_DOCUMENT])]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "sentence", "code"])

    found = some.mapInPandas(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at int, sentence string, code string")
    by = Window.partitionBy("code").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at")
    rows = found.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= per_label).orderBy("code", "_k").collect()
    if not rows:
        return None
    folds = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in rows])
    return Model.train([r["sentence"] for r in rows], [r["code"] for r in rows], folds)


def segments(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """One row per stretch in one language: doc_id, ``keep``, segment_no, start, end, lang, confidence, sentences.

    ``start`` and ``end`` are character offsets, ``sentences`` counts the whole sentences, so it is
    0 for a text of fragments only. The confidence is the mean over
    the stretch's pieces, weighted by length. A sentence below a confidence
    of one half joins the language before it (at the beginning, the one after), and so does a fragment
    of fewer than LEAST_WORDS words beside sentences. Null
    and blank texts and texts without letters give no row. A piece that comes
    again in a batch is judged once. Columns of ``keep`` are handed through.
    """
    keep = keep or []
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    head = "".join(f"`{c}` {kinds[c]}, " for c in ["doc_id", *keep])
    schema = f"{head}segment_no int, start int, `end` int, lang string, confidence double, sentences int"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    rows = docs.select("doc_id", *keep, "text").where("doc_id is not null and text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    names = ["segment_no", "start", "end", "lang", "confidence", "sentences"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(shared.value)
        for b in batches:
            seen: dict[str, str] = {}
            cuts = [pieces(t, seen) for t in b["text"]]
            texts = list(dict.fromkeys(p[2] for c in cuts for p in c))
            langs, sure = known.predict(texts)
            judged = dict(zip(texts, zip(langs, sure.tolist())))
            out, at = [], []
            for k, spans in enumerate(cuts):
                segs = _runs(spans, [judged[p[2]] for p in spans])
                out += segs
                at += [k] * len(segs)
            own = b[["doc_id", *keep]].iloc[at].reset_index(drop=True)
            found = pd.DataFrame(out, columns=names)
            yield pd.concat([own, found], axis=1)

    return rows.mapInPandas(run, schema)


def _runs(spans: list, judged: list[tuple[str, float]]) -> list[tuple]:
    """Stretches of equal language."""
    named = [lang for lang, _ in judged]
    some = any(whole for *_, whole in spans)
    firm = [
        i for i, (_, _, letters, whole) in enumerate(spans)
        if judged[i][1] >= 0.5 and (whole or not some or letters.count(" ") + 1 >= LEAST_WORDS)
    ]
    if firm:
        held = set(firm)
        for i in range(len(spans)):
            if i not in held:
                named[i] = named[i - 1] if i > firm[0] else named[firm[0]]
    out, at = [], 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or named[i] != named[at]:
            part = range(at, i)
            size = sum(spans[j][1] - spans[j][0] for j in part)
            sure = sum((spans[j][1] - spans[j][0]) * judged[j][1] for j in part) / size
            out.append((len(out) + 1, spans[at][0], spans[i - 1][1], named[at], sure, sum(spans[j][3] for j in part)))
            at = i
    return out


def languages(segs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, keep, lang, confidence, share, sentences): every language of each document; sentences is 0 for one of fragments only."""
    keys = ["doc_id", *(keep or [])]
    size = F.col("end") - F.col("start")
    per = segs.groupBy(*keys, "lang").agg(
        (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"), F.sum(size).alias("_size"), F.sum("sentences").alias("sentences")
    )
    whole = Window.partitionBy(*keys)
    return per.withColumn("share", F.col("_size") / F.sum("_size").over(whole)).drop("_size")


def doubtful(langs: DataFrame, label: str = "label") -> DataFrame:
    """(doc_id, lang): the languages, with a whole sentence each, of documents whose ``label`` is missing or wrong, or which have several.

    ``langs`` is ``languages`` output that keeps the label.
    """
    rows = langs.where("sentences > 0").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", label)))
    right = (F.col("_n") == 1) & F.coalesce(label_code(F.col(label)) == F.col("lang"), F.lit(False))
    return rows.where(~right).select("doc_id", "lang").distinct()
