"""Languages of documents, paragraphs and segments by compression.

Each language has a raw-content dictionary of sample text. A piece of text is compressed with every
dictionary; the language whose dictionary gives the smallest result wins, and where the second is nearly as
small the piece is left without a language. Long or unclear paragraphs are classified by chunks of
sentences, unclear chunks sentence by sentence, and a paragraph gets the language of most of its words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.batches import text_batches

#: The languages, with their ISO 639-1 and ISO 639-2 or -3 codes.
CODES = {
    "en": ("eng",),
    "de": ("deu", "ger"),
    "fr": ("fra", "fre"),
    "es": ("spa",),
    "pt": ("por",),
    "it": ("ita",),
    "nl": ("nld", "dut"),
    "pl": ("pol",),
    "ru": ("rus",),
    "zh": ("zho", "chi"),
}
LANGUAGES = tuple(CODES)

MARGIN = 0.16  # least lead of the smallest size over the second, relative to the second
CLEAR = 0.30  # a lead at which a chunk is taken to be of one language
CHUNK = 480  # characters of sentences that are classified together
SAMPLES = 10_000  # checked samples that may enter the dictionaries
SAMPLE_DOCUMENTS = 4_000  # labelled documents whose text may enter the dictionaries
DICTIONARY_BYTES = 48_000  # of each language

_BREAK = re.compile(r"\r?\n(?:[ \t]*\r?\n)+")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？；])|[\r\n]+")
# what makes an ASCII word code, a link or a number; words of other scripts may touch such words
_CODE = re.compile(r"[_/\\<>=@{}\[\]|$#*+~^0-9]|::|[a-z]\(\)")
_CODE_WORD = re.compile(rf"[!-~]*(?:{_CODE.pattern})[!-~]*")
_SPAN = re.compile(r"`[^`\n]*`")
_CJK = re.compile(r"[㐀-鿿]")
_CARRIER = b" " * 64  # keeps the block compressible, so that savings show in the size of the shortest text


def stated_language(label: Column) -> Column:
    """Two-letter code that a label states, null if none of LANGUAGES: case, spaces and region don't count."""
    base = F.split(F.lower(F.regexp_replace(label, r"\s+", "")), "[-_]")[0]
    known = {c: k for k, codes in CODES.items() for c in (k, *codes)}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[base]


def _plain_lines(text: str) -> list[str]:
    """Lines of lower-case words, without code spans, links, identifiers, numbers and surplus space."""
    if "`" in text:
        text = _SPAN.sub(" ", text)
    return [
        " ".join(w if w.isalpha() or not _CODE.search(w) else "" if w.isascii() else _CODE_WORD.sub(" ", w) for w in line.split())
        for line in text.lower().splitlines()
    ]


def plain_words(text: str) -> str:
    """The words of all lines of a text as one line."""
    return " ".join(" ".join(_plain_lines(text)).split())


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number, text outside code fences) of the parts between blank lines."""
    fenced, number = False, 0
    for part in _BREAK.split(text):
        if not part.strip():
            continue
        outside = []
        for i, piece in enumerate(part.split("```")):
            fenced ^= i > 0
            if not fenced:
                outside.append(piece)
        yield number, "\n".join(outside)
        number += 1


def _count_words(text: str) -> float:
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    return len(_CJK.sub(" ", text).split()) + cjk / 2 if cjk else len(text.split())


class Classifier:
    """Compressors with one dictionary per language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zs

        options = zs.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=1, min_match=4, target_length=0, strategy=zs.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.languages = sorted(dictionaries)
        self.compress = []
        for k in self.languages:
            d = zs.ZstdCompressionDict(dictionaries[k], dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=options)
            self.compress.append(zs.ZstdCompressor(dict_data=d, compression_params=options).compress)
        self.base = [len(c(_CARRIER)) for c in self.compress]

    def lead(self, words: str) -> tuple[str | None, float]:
        """(language, relative lead over the second) of normalised text; None on a tie. Every dictionary is tried."""
        whole = words.encode("utf-8", "surrogatepass") + _CARRIER
        sizes = sorted((len(c(whole)) - b, k) for k, c, b in zip(self.languages, self.compress, self.base))
        first, second = sizes[0][0], max(1, sizes[1][0] if len(sizes) > 1 else len(whole))
        lead = min(1.0, max(0.0, (second - first) / second))
        return (sizes[0][1] if lead > 0 else None), lead

    def pieces(self, text: str) -> list[tuple[str | None, float, float]]:
        """(language, confidence, words) of consecutive pieces of a paragraph."""
        out: list[tuple[str | None, float, float]] = []
        chunk: list[str] = []

        def flush() -> None:
            if not chunk:
                return
            whole = " ".join(chunk)
            language, lead = self.lead(whole)
            if len(chunk) == 1 or lead >= CLEAR:
                out.append((language if lead >= MARGIN else None, lead, _count_words(whole)))
            else:
                for s in chunk:
                    own, own_lead = self.lead(s)
                    if own_lead < MARGIN:
                        own, own_lead = (language, lead) if lead >= MARGIN else (None, own_lead)
                    out.append((own, own_lead, _count_words(s)))
            chunk.clear()

        size = 0
        for sentence in _SENTENCE.split("\n".join(_plain_lines(text))):
            words = " ".join(sentence.split())
            if not any(map(str.isalpha, words)):
                continue
            if size + len(words) > CHUNK:
                flush()
                size = 0
            chunk.append(words)
            size += len(words)
        flush()
        return out

    def paragraph(self, text: str) -> tuple[str | None, float]:
        """(language of most words, confidence): the pieces' leads of that language, weighted by words."""
        weight: dict[str, float] = defaultdict(float)
        lead: dict[str, float] = defaultdict(float)
        total = 0.0
        for language, c, n in self.pieces(text):
            total += n
            if language:
                weight[language] += n
                lead[language] += n * c
        if not weight:
            return None, 0.0
        best = max(weight, key=lambda k: (weight[k], k))
        return best, min(1.0, lead[best] / max(total, 1e-9))


def fit_dictionaries(samples: DataFrame, documents: DataFrame | None = None, max_samples: int = SAMPLES, max_documents: int = SAMPLE_DOCUMENTS, max_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from checked samples (lang, text) and a bounded sample of documents.

    At most ``max_samples`` samples (of more, those with the least hash) and ``max_documents`` documents (of 80 to 4,000 characters, those with the least
    hash of their id) come to the driver. A document's text enters the dictionary of the language that its
    label states if the dictionaries of the checked samples find the same language with a clear lead, until
    the dictionary is full. Classification itself covers every document and its whole text.
    """
    texts: dict[str, list[str]] = defaultdict(list)
    rows = samples.select(stated_language(F.col("lang")).alias("k"), "text").where("k is not null and text is not null")
    for r in rows.orderBy(F.xxhash64("text"), "k").limit(max_samples).collect():
        texts[r.k].append(plain_words(r.text))
    seeds = {k: " ".join(x).encode() for k, x in texts.items()}
    if documents is None or len(seeds) < 2:
        return {k: v[-max_bytes:] for k, v in seeds.items()}
    first, size = Classifier(seeds), {k: len(v) for k, v in seeds.items()}
    more: dict[str, list[str]] = defaultdict(list)
    labelled = documents.select("doc_id", "text", stated_language(F.col("lang")).alias("k")).where(
        (F.length("text") >= 80) & (F.length("text") <= 4000) & F.col("k").isNotNull())
    for r in labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_documents).collect():
        for _, text in paragraphs(r.text):
            words = plain_words(text)
            if size.get(r.k, max_bytes) >= max_bytes or len(words) < 60:
                continue
            language, lead = first.lead(words)
            if language == r.k and lead >= 0.15:
                more[r.k].append(words)
                size[r.k] += len(words.encode()) + 1
    return {k: (" ".join(more[k]).encode() + b" " + v)[-max_bytes:] for k, v in seeds.items()}


def _run(documents: DataFrame, samples: DataFrame, train: bool, schema: str, emit) -> DataFrame:
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fit_dictionaries(samples, documents if train else None))  # at most 10 x max_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for b in text_batches(batches, "text"):
            rows = [row for doc, text, stated in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "stated"))) for row in emit(classifier, doc, text or "", stated)]
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return documents.select("doc_id", "text", stated_language(F.col("lang")).alias("stated")).mapInArrow(run, schema)


def paragraph_languages(documents: DataFrame, samples: DataFrame, train: bool = True) -> DataFrame:
    """(doc_id, para_no, lang, confidence, stated) of every paragraph of every row of documents.

    Paragraphs are the parts between blank lines, numbered from 0; those in code fences, and those in which no
    language leads clearly, have a null lang and confidence 0. stated is the language of the label, null if it
    states none of the ten. A null, empty or blank text has no paragraphs. Repeated rows give repeated rows.
    """

    def emit(classifier, doc, text, stated):
        for number, outside in paragraphs(text):
            language, confidence = classifier.paragraph(outside)
            yield doc, number, language, round(confidence, 4), stated

    return _run(documents, samples, train, "doc_id bigint, para_no int, lang string, confidence double, stated string", emit)


def segment_languages(documents: DataFrame, samples: DataFrame, train: bool = True) -> DataFrame:
    """(doc_id, para_no, seg_no, lang, confidence, words): runs of one language within paragraphs."""

    def emit(classifier, doc, text, stated):
        for number, outside in paragraphs(text):
            runs: list[list] = []
            for language, lead, n in classifier.pieces(outside):
                if runs and runs[-1][0] == language:
                    runs[-1][1] += lead * n
                    runs[-1][2] += n
                else:
                    runs.append([language, lead * n, n])
            for i, (language, lead, n) in enumerate(runs):
                yield doc, number, i, language, round(lead / n, 4) if language and n else 0.0, float(n)

    return _run(documents, samples, train, "doc_id bigint, para_no int, seg_no int, lang string, confidence double, words double", emit)


def document_languages(documents: DataFrame, samples: DataFrame, train: bool = True) -> DataFrame:
    """(doc_id, lang, confidence, stated): the language of most words of each row of documents, null if none."""

    def emit(classifier, doc, text, stated):
        weight: dict[str, float] = defaultdict(float)
        total = 0.0
        for _, outside in paragraphs(text):
            for language, lead, n in classifier.pieces(outside):
                total += n
                if language:
                    weight[language] += n * (lead + 1)
        best = max(weight, key=lambda k: (weight[k], k)) if weight else None
        yield doc, best, round(min(1.0, weight[best] / (2 * total)), 4) if best else 0.0, stated

    return _run(documents, samples, train, "doc_id bigint, lang string, confidence double, stated string", emit)


def wrong_labels(documents: DataFrame, samples: DataFrame, train: bool = True) -> DataFrame:
    """Distinct (doc_id, para_no, lang) of paragraphs whose language isn't the one the label states."""
    found = paragraph_languages(documents, samples, train)
    return found.where(F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("stated"))).select("doc_id", "para_no", "lang").distinct()
