"""Language identification: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Documents of a language that are learned from, about. Every language is learned.
TRAIN_DOCS = 5000
BUCKETS = 1 << 16
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: A language is a candidate for a script with this share of its training letters or more.
SCRIPT_SHARE = 0.01
#: Cost of a word for languages that don't use its script, if others do.
FOREIGN = 30.0
UNDETERMINED = "und"
CHUNK_CHARS = 400_000

# First and last code point of scripts' blocks. Letters elsewhere count as one more script.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x2DE0, 0x2DFF),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0xFB50, 0xFEFF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
]
SCRIPTS = ["none", "other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@functools.cache
def script_table() -> np.ndarray:
    """The script of every code point: 0 for anything but letters."""
    script = np.ones(0x110000, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return np.where([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], script, 0).astype(np.uint8)


@dataclass
class Words:
    """The words of some texts: runs of letters."""

    letters: np.ndarray  # of each word
    script: np.ndarray  # of its first letter
    at: np.ndarray  # first word of each text, one more entry than texts
    bucket: np.ndarray  # of the three-letter context of every letter of all words
    first: np.ndarray  # place of each word's first letter among these


def words_of(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_table()[code]
    place = np.flatnonzero(script)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    code = np.where(script > 0, code, 0).astype(np.uint32)
    here, before, after = code[place], code[place - 1], code[place + 1]  # a blank ends the whole, so both exist; the first letter's left one is that blank
    mixed = before * np.uint32(0x9E3779B1) + here * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(np.diff(place, prepend=-2) > 1)
    return Words(np.diff(np.append(first, len(place))), script[place[first]], np.searchsorted(place[first], bounds), (mixed >> np.uint32(16)).astype(np.intp), first)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probability of each bucket, languages x BUCKETS
    candidate: np.ndarray  # whether a language uses a script, languages x scripts
    switch: float = SWITCH
    known: np.ndarray = field(init=False)
    expected: np.ndarray = field(init=False)  # log probability of a letter of text like that learned from

    def __post_init__(self):
        self.known = self.candidate.any(axis=0)
        self.expected = (np.exp(self.table.astype(np.float64)) * self.table).sum(axis=1)

    def word_scores(self, words: Words) -> np.ndarray:
        """Log probability of each word under each language; a script that none uses tells nothing."""
        if not len(words.first):
            return np.zeros((len(self.languages), 0))
        scores = np.stack([np.add.reduceat(row[words.bucket], words.first) for row in self.table]).astype(np.float64)
        scores[:, ~self.known[words.script]] = 0
        return np.where(self.candidate[:, words.script] | ~self.known[words.script], scores, scores - FOREIGN)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word that Viterbi finds; the switching cost is the same between any two languages."""
        best = int(scores.sum(axis=1).argmax())
        gain = np.cumsum(scores - scores[best], axis=1)
        gain = np.concatenate([np.zeros((len(scores), 1)), gain], axis=1)
        # No stretch gains half a switch in another language: k stretches gain less than their k - 1 switches cost.
        if (gain - np.minimum.accumulate(gain, axis=1)).max() <= self.switch / 2:
            return np.full(scores.shape[1], best)
        total = scores[:, 0].tolist()
        back = []
        for column in scores[:, 1:].T.tolist():
            top = max(total)
            lead, floor = total.index(top), top - self.switch
            back.append([k if t >= floor else lead for k, t in enumerate(total)])
            total = [(t if t >= floor else floor) + c for t, c in zip(total, column, strict=True)]
        at = total.index(max(total))
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return np.array(out[::-1])


    def long_path(self, parts: Iterator[np.ndarray]) -> np.ndarray:
        """What path() finds, from the scores of one part of a text after the other: a few bytes a word are kept."""
        total, leads, stays = None, [], []
        for scores in parts:
            for column in scores.T:
                if total is None:
                    total = column
                    continue
                lead = int(total.argmax())
                floor = total[lead] - self.switch
                leads.append(lead)
                stays.append(np.packbits(total >= floor).tobytes())
                total = np.maximum(total, floor) + column
        at = int(total.argmax())
        out = np.empty(len(leads) + 1, np.int32)
        out[-1] = at
        for k in range(len(leads) - 1, -1, -1):
            at = at if stays[k][at >> 3] >> (7 - (at & 7)) & 1 else leads[k]
            out[k] = at
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter contexts and scripts of each language of this task's documents."""
    buckets: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words_of([text])
            buckets.setdefault(lang, np.zeros(BUCKETS, np.int64))
            buckets[lang] += np.bincount(w.bucket, minlength=BUCKETS)
            scripts.setdefault(lang, np.zeros(len(SCRIPTS), np.int64))
            scripts[lang] += np.bincount(w.script, w.letters, len(SCRIPTS)).astype(np.int64)
    names = sorted(buckets)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([buckets[k].tobytes() for k in names], pa.binary()), pa.array([scripts[k].tobytes() for k in names], pa.binary())], names=["lang", "buckets", "scripts"])


def learn(docs: DataFrame, per_language: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of docs' languages, from about per_language documents of each, chosen by a hash of the id.

    Rows without text or language are passed over. What comes to the driver is bounded by the number of
    languages and tasks: counts of BUCKETS contexts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * (1 << 30)).cast("long").alias("share"))  # a row a language
    sample = rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")).select("lang", "text")
    parts = min(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found: dict[str, list] = {}
    for r in sample.repartition(parts).mapInArrow(_count, "lang string, buckets binary, scripts binary").toLocalIterator():
        b, s = np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64)
        held = found.setdefault(r[0], [np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)])
        held[0] += b
        held[1] += s
    names = sorted(found)
    buckets = np.array([found[k][0] for k in names], np.float64).reshape(-1, BUCKETS)
    scripts = np.array([found[k][1] for k in names], np.float64).reshape(-1, len(SCRIPTS))
    table = np.log((buckets + 0.05) / (buckets.sum(axis=1, keepdims=True) + 0.05 * BUCKETS)).astype(np.float32)
    return Model(names, table, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True)))


SPAN = pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])


def _parts(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters, cut between words."""
    script, at = script_table(), 0
    while at < len(text):
        end = at + most
        while end < len(text) and script[ord(text[end])]:
            end += 1
        yield text[at:end]
        at = end


def _labelled(model: Model, path: np.ndarray, letters: np.ndarray, likely: float) -> tuple[str, float, float, list[dict]]:
    each = np.bincount(path, letters, len(model.languages))
    top = int(each.argmax())
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    spans = [{"first_word": s, "words": e - s, "lang": model.languages[path[s]]} for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return model.languages[top], float(each[top] / each.sum()), float((likely - each @ model.expected) / each.sum()), spans


def _likely(model: Model, words: Words, scores: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Log probability of each word in its language; letters of a script that no language uses are as unlikely as can be."""
    return np.where(model.known[words.script], scores[path, np.arange(len(path))], model.table.min() * words.letters.astype(np.float64))


def _label(model: Model, texts: list[str]) -> Iterator[tuple[str, float, float, list[dict]]]:
    words = words_of(texts)
    scores = model.word_scores(words) if model.languages else None
    for i in range(len(texts)):
        a, b = words.at[i], words.at[i + 1]
        if a == b or scores is None:
            yield UNDETERMINED, 0.0, 0.0, []
            continue
        path = model.path(scores[:, a:b])
        own = Words(words.letters[a:b], words.script[a:b], words.at, words.bucket, words.first)
        yield _labelled(model, path, own.letters, float(_likely(model, own, scores[:, a:b], path).sum()))


def _label_long(model: Model, text: str, most: int) -> tuple[str, float, float, list[dict]]:
    """As _label, for one text that is scored in parts."""
    cuts = [words_of([part]) for part in _parts(text, most)] if model.languages else []
    if not sum(len(w.first) for w in cuts):
        return UNDETERMINED, 0.0, 0.0, []
    path, at, likely = model.long_path(model.word_scores(w) for w in cuts), 0, 0.0
    for w in cuts:
        likely += float(_likely(model, w, model.word_scores(w), path[at : at + len(w.first)]).sum())
        at += len(w.first)
    return _labelled(model, path, np.concatenate([w.letters for w in cuts]), likely)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, fit and spans: nothing but the text is looked at.

    Words are runs of letters. Every word is scored under each language whose training text uses its
    script, and the path of languages with the highest total, less a cost for each change, labels the
    words. lang_pred has most letters (of equals, the first by name), score is its share of the letters, fit is how much
    likelier or, if negative, less likely a letter is than one of text like that learned from (in nats; text in a language that wasn't
    learned is far below), spans are its runs: first_word, words, lang. Null or letterless text: und, score and fit 0, no spans. So is
    everything if the model has no language. Columns of these four names are replaced. Long texts are scored in parts.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "fit", "spans")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 8 * CHUNK_CHARS // max(8, len(held.value.languages))
        for batch in batches:
            texts = batch.column(where).to_pylist()
            out, chunk, size = [], [], 0
            for t in texts:
                if len(t or "") > 2 * most:
                    out += _label(held.value, chunk)
                    out.append(_label_long(held.value, t, most))
                    chunk, size = [], 0
                    continue
                chunk.append(t or "")
                size += len(chunk[-1])
                if size >= most:
                    out += _label(held.value, chunk)
                    chunk, size = [], 0
            out += _label(held.value, chunk)
            added = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.list_(SPAN)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "lang_pred", "score", "fit", "spans"])

    added = StructType.fromDDL("lang_pred string, score double, fit double, spans array<struct<first_word:int,words:int,lang:string>>")
    schema = StructType([*docs.schema.fields, *added.fields])
    return docs.mapInArrow(run, schema)
