"""Secret scan: fixed patterns, and novelty measured with primed zstandard.

Base kinds assign, access and hex follow fixed patterns, leftmost and without overlap for each kind. The method adds
``novel`` spans: long unbroken strings close to a sensitive word whose marginal compressed size, given the text around
them and the dictionaries, is almost that of random characters. The marginal size of a candidate is
size(before + candidate + after) - size(before + after), both compressed with the primed dictionary. It is measured for
base spans too and reported as their score (bytes per character, at most 1); base spans stay whatever their score.

The dictionary has two parts: what code is made of (``CODE``), and the identifiers of the corpus itself, which ``fit`` counts
over all documents. Identifiers are whole words of 4 to 15 letters; pieces of longer or mixed strings, and so of secrets,
are never counted, and a word counts once a document.

Defined cases: with no document that has a word the dictionary is ``CODE`` alone; words of equal count come in
alphabetical order; a null text is read as empty, an empty text has no spans, offsets are code points, a novel span that
overlaps a base span is not reported again, repeated rows are scanned alike, and every scan is linear in the text's
length. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import arrow_map, id_and_text, table, tidy
from veridock.llm.spans import Digest, Redact, Spans, digest

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
#: Characters of surrounding text that prime the compressor on either side, and within which a sensitive word counts.
AROUND, REACH = 256, 48
#: Characters of a candidate that are measured at once, and the bytes per character that count as novel.
MEASURED, NOVEL = 512, 0.62
#: Words of the corpus in the dictionary.
IDENTIFIERS = 4000

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_IDENTIFIER = r"(?<![A-Za-z0-9+/=_.-])([A-Za-z]{4,15})(?![A-Za-z0-9+/=_-])"
_SENSITIVE = re.compile(r"passw|secret|token|api.?key|credential|private|auth|bearer|access|signature|client|login", re.IGNORECASE | re.ASCII)

#: Primes the compressor with what code and identifiers are made of.
CODE = (
    " import from return def class self None True False public static void int string const let var function lambda"
    " for while if else elif try except finally raise throw catch new delete select insert update where join group order"
    " get set put post delete patch request response header body json xml html http https www com org net api v1 v2 url"
    " user username email password passwd secret token api_key apikey access_key client_id client_secret private public"
    " key value name id index count size length offset limit page start end first last next prev begin min max sum avg"
    " config settings environment production staging development test debug release version build deploy server client"
    " database host port localhost 127.0.0.1 0.0.0.0 8080 443 5432 3306 connection timeout retry session cookie cache"
    " read write open close file path dir directory folder upload download stream buffer byte array list map dict tuple"
    " error warning info message exception stack trace handler callback event listener queue worker thread process"
    " abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0x00 0xff 1234567890 example placeholder changeme"
    " xxxxxxxxxxxxxxxx 0000000000000000 ---------------- ================ ________________ ################ tion ment"
    " Authorization: Bearer Content-Type: application/json User-Agent: Mozilla/5.0 Accept: */* Set-Cookie: Basic "
).encode()


@cache
def _squeeze(content: bytes):
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def fit(docs: DataFrame, text_col: str = "text", words: int = IDENTIFIERS) -> bytes:
    """The dictionary: the corpus's ``words`` most frequent identifiers, rarest first as near content is cheapest to refer to,
    then ``CODE``. Counted over all documents with partial aggregation; the dictionary's words alone reach the driver."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_IDENTIFIER)))).alias("w"))
    counts = found.groupBy("w").agg(F.count("*").alias("n"))
    # a last shuffle, so that the best of all partitions are brought together in a task and not on the driver
    best = [r["w"] for r in sorted(counts.orderBy(F.desc("n"), "w").limit(words).repartition(1).collect(), key=lambda r: (-r["n"], r["w"]))]
    tidy(docs.sparkSession)
    return " ".join([*best[::-1], ""]).encode() + CODE


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """A span in parts of ``MEASURED`` characters; what is left over goes with the last, so all of it is measured."""
    cuts = [*range(start, max(start + 1, end - MEASURED + 1), MEASURED), end]
    return list(zip(cuts, cuts[1:], strict=False))


class Scanner:
    """Texts to spans, with one dictionary."""

    def __init__(self, dictionary: bytes = CODE):
        self.dictionary = dictionary

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes of a span per byte of it, from 0 to 1; of its most novel part if it is long."""
        before, after = text[max(0, start - AROUND) : start].encode("utf-8", "replace"), text[end : end + AROUND].encode("utf-8", "replace")
        squeeze = _squeeze(self.dictionary)
        base = len(squeeze(before + after))
        most = 0.0
        for a, b in parts(start, end):
            part = text[a:b].encode("utf-8", "replace")
            most = max(most, (len(squeeze(before + part + after)) - base) / len(part))
        return min(1.0, max(0.0, most))

    def __call__(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, novelty), kind by kind."""
        base = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
        found = [(kind, s, e, self.novelty(text, s, e)) for kind, s, e in base]
        taken = sorted((s, e) for _, s, e in base)
        k = 0
        for m in _CANDIDATE.finditer(text):
            s, e = m.span()
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if any(a < e and s < b for a, b in taken[max(0, k - 3) : k + 3]) or not _mixed(m[0]):
                continue
            if _SENSITIVE.search(text, max(0, s - REACH), min(len(text), e + REACH)) and (x := self.novelty(text, s, e)) >= NOVEL:
                found.append(("novel", s, e, x))
        return found


scan = Scanner()


def _mixed(token: str) -> bool:
    """Words and plain numbers are no secrets: digits and letters, or both cases inside."""
    digits, lower, upper = (any(a <= c <= b for c in token) for a, b in ("09", "az", "AZ"))
    return digits and (lower or upper) or lower and upper


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, value, score."""
    return arrow_map(id_and_text(docs, id_col, text_col), Spans(Scanner(fit(docs, text_col)), KINDS), Spans.schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows with each span replaced by its kind in brackets; ``length_col`` holds the texts' lengths, if any column
    does."""
    return arrow_map(docs, Redact(Scanner(fit(docs, text_col)), KINDS, text_col, length_col), docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(docs, Digest(Scanner(fit(docs)), BASE, KINDS))


QUERIES = {"op6_secret_scan": op6_secret_scan}
SQL: dict[str, str] = {}
