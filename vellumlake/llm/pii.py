"""PII by bootstrapped contextual extraction.

Candidate instances are identifier-like strings: runs with digits or '@', joined over blanks where they read as one number.  Each carries
lexical patterns: its shape (characters collapsed to classes, with whether a check digit holds), and its shape class
in context (the whole word before it with the marks between, and the marks or else the whole word behind it).  Seed entities, taken by strict validation or
given as a table, start at confidence 1.  Then Spark scores the pattern-instance graph iteratively: a pattern is as confident as the
share of its instances' mass that is confident, an instance as confident as its best patterns together.  Patterns of high
confidence discover the identifiers that no validator knows.

Defined cases: null and empty texts, and texts without a candidate, report nothing; repeated rows report each; candidates of rows with
null doc_id count in the graph and are not reported; without seeds, or from an empty table, the result is empty; extra columns
are ignored, and pass through masking.  Offsets are in characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, free_name, written

ROUNDS = 4
PATTERN_CONFIDENCE = 0.8
LEAST_INSTANCES = 2
BROADCAST_PATTERNS = 200_000
KINDS = ("email", "ip", "phone", "card", "secret")

# one scan finds all candidates; what is one number in several groups is one candidate
_CANDIDATE = re.compile(
    r"(?<![\w.+-])[\w.+-]++(?<=\w)@\w[\w.-]*\w"  # something at something; a run without @ is looked at once
    r"|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,5}){2,4}(?!\w|\.\d)"  # international number
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
    r"|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"  # dotted quad
    r"|(?<!\w)\d{4}(?:[ -]\d{4}){3}(?!\w)"  # number in fours
    r"|(?<!\w)(?=\w*\d)\w{6,}(?!\w)"  # any longer word that holds a digit
)
_HINT = re.compile(r"[\d@]")  # every candidate has one
_CARD = re.compile(r"\d{13,19}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def shape(s: str) -> str:
    """Character classes, runs collapsed; long runs keep their length, and card-like numbers whether their check digit holds."""
    if s.isascii() and s.isdigit():
        return f"9{{{len(s)}}}" + (("+check" if luhn(s) else "-check") if 13 <= len(s) <= 19 else "")
    if len(s) >= 24 and re.fullmatch(r"[0-9a-fA-F]+", s):
        return f"hex{{{len(s)}}}"
    plain = re.sub(r"[ -]", "", s)
    if _CARD.match(plain) and len(plain) != len(s):
        return re.sub(r"\d", "9", s) + ("+check" if luhn(plain) else "-check")
    if "@" in s:
        host = s.rsplit("@", 1)[1]
        return "@" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", host))
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: "9" * min(4, len(m.group())), s))


def seed_kind(s: str, left: str) -> str:
    """The kind of an identifier that strict validation alone is sure of; '' otherwise."""
    if "@" in s:
        return "email" if re.fullmatch(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", s) else ""
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 and str(int(p)) == p for p in parts):
        return "ip"
    if re.fullmatch(r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}", s):
        return "phone"
    digits = re.sub(r"[ -]", "", s)
    if _CARD.match(digits) and digits.isascii():
        return "card" if luhn(digits) and digits.strip(digits[0]) else ""
    if len(s) >= 32 and re.fullmatch(r"[0-9a-f]+", s) and re.search(r"(?i)\b(?:token|secret|key|password|api_key)\s*[=:]\s*[\"']$", left):
        return "secret"
    return ""


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    """(the word before a with all that lies between, the marks right behind b or else the next word), however long.

    A word lies next to two candidates at most, so that all contexts of a text together are linear in it.
    """
    i = a
    while i and not _in_word(text[i - 1]):
        i -= 1
    while i and _in_word(text[i - 1]):
        i -= 1
    size, j = len(text), b
    while j < size and not text[j].isspace() and not _in_word(text[j]):
        j += 1
    if j > b:
        return text[i:a], text[b:j]
    while j < size and not _in_word(text[j]):
        j += 1
    k = j
    while k < size and _in_word(text[k]):
        k += 1
    return text[i:a], text[j:k].lower() or "$"


def mentions(text: str):
    """(start, end, instance, patterns, seed kind) of each candidate in a text."""
    if not _HINT.search(text):
        return
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        s = m.group()
        if s.isalpha() or (s[0] == "_"):
            continue
        left, after = _around(text, a, b)
        before = " ".join(left.split()).lower() or "^"
        cue = before if left[-1:] in "\"'=:" and left else ""
        sh = shape(s)
        if sh.startswith(("hex", "9{")) or "check" in sh or "@" in sh:
            broad = sh
        else:
            broad = re.sub(r"9+", "9", sh)
        patterns = [f"shape {broad}"]
        if cue:
            patterns.append(f"cue {cue} _ {broad}")
        else:
            patterns += [f"left {before} _ {broad}", f"right {broad} _ {after}"]
        yield a, b, s, patterns, seed_kind(s, left)


_MENTIONS = "doc_id long, text_key long, start int, end int, instance string, patterns array<string>, kind string"


def _finder(batches):
    for batch in batches:
        ids, keys, out = batch.column(0), batch.column(1), []
        for r, text in enumerate(batch.column(2).to_pylist()):
            if text:
                out += [(r, *m) for m in mentions(text)]
        if out:
            r, a, b, s, p, k = zip(*out)
            cols = [ids.take(pa.array(r)), keys.take(pa.array(r)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s, pa.string()), pa.array(p, pa.list_(pa.string())), pa.array(k, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "start", "end", "instance", "patterns", "kind"])


def candidates(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_finder, _MENTIONS)


def bootstrap(found: DataFrame, seeds: DataFrame | None = None, rounds: int = ROUNDS, least_instances: int = LEAST_INSTANCES) -> DataFrame:
    """(pattern, kind, confidence, instances) after `rounds` of scoring the graph of `found` (see candidates)."""
    edges = cut(found.select("instance", F.explode("patterns").alias("pattern")).distinct())
    if seeds is None:
        seeds = found.where("kind <> ''").select("instance", "kind")
    seeded = cut(seeds.select("instance", "kind").where("instance is not null and kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")))
    scores = seeded.withColumn("confidence", F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    patterns = None
    for turn in range(rounds):
        mass = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"))
        patterns = mass.join(sizes, "pattern").where(F.col("instances") >= least_instances).select("pattern", "kind", "instances", (F.col("mass") / (F.col("instances") + F.lit(0.5))).alias("confidence"))
        patterns = cut(patterns)
        if turn + 1 < rounds:
            # a shape vouches for its instances by itself; contexts together with it
            doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence") * F.col("confidence")))))
            reached = edges.join(patterns.where("confidence >= 0.3"), "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("confidence"))
            scores = cut(reached.unionByName(seeded.withColumn("confidence", F.lit(1.0))).groupBy("instance", "kind").agg(F.max("confidence").alias("confidence")))
    return patterns


def extracted(docs: DataFrame, seeds: DataFrame | None = None, rounds: int = ROUNDS, confidence: float = PATTERN_CONFIDENCE, least_instances: int = LEAST_INSTANCES) -> DataFrame:
    """One row an identifier occurrence: doc_id, start, end (characters), kind, instance, confidence, seeded.

    An occurrence is reported when a pattern of at least `confidence` matches it, or when it is a seed.
    """
    found = written(candidates(docs), "pii-candidates")
    patterns = bootstrap(found, seeds, rounds, least_instances)
    strong = patterns.where(F.col("confidence") >= confidence).select("pattern", F.col("kind").alias("as_kind"), "confidence")
    at = found.where("doc_id is not null").select("doc_id", "start", "end", "instance", "kind", F.explode("patterns").alias("pattern"))
    best = at.join(strong, "pattern").groupBy("doc_id", "start", "end", "instance", "kind").agg(F.max(F.struct("confidence", "as_kind")).alias("best"))
    matched = best.select("doc_id", "start", "end", F.col("best.as_kind").alias("kind"), "instance", F.col("best.confidence").alias("confidence"), (F.col("kind") != "").alias("seeded"))
    alone = found.where("doc_id is not null and kind <> ''").select("doc_id", "start", "end", "kind", "instance").distinct().join(matched.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")
    return matched.unionByName(alone.withColumns({"confidence": F.lit(1.0), "seeded": F.lit(True)}))


def _redact(text: str, spans) -> str:
    out, last = [], 0
    for a, b, kind in sorted(spans):
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def _masker(shared, name: str = ""):
    def run(batches):
        known = shared.value if shared else None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            given = batch.column(batch.schema.get_field_index(name)).to_pylist() if known is None else None
            for r, text in enumerate(texts):
                if not text:
                    continue
                if known is None:
                    spans = [(x["start"], x["end"], x["kind"]) for x in given[r] or ()]
                else:
                    spans = [(a, b, max((known[p] for p in pats if p in known), default=(1.0, kind))[1]) for a, b, _, pats, kind in mentions(text)]
                if spans := [x for x in spans if x[2]]:
                    texts[r] = _redact(text, spans)
            new = pa.array(texts, pa.string())
            keep = [i for i, n in enumerate(batch.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in keep], [batch.schema.names[i] for i in keep])

    return run


def masked(docs: DataFrame, rounds: int = ROUNDS, confidence: float = PATTERN_CONFIDENCE, least_instances: int = LEAST_INSTANCES, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """docs with each identifier in text replaced by its kind in brackets, and n_chars (where there is one) recounted.

    Up to `broadcast_patterns` confident patterns are broadcast and applied where texts are read; beyond, occurrences are
    matched by a join and brought to their texts by another.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    found = written(candidates(docs), "pii-candidates")
    strong = cut(bootstrap(found, None, rounds, least_instances).where(F.col("confidence") >= confidence).select("pattern", F.col("kind").alias("as_kind"), "confidence"))
    if strong.count() <= broadcast_patterns:
        known: dict[str, tuple[float, str]] = {}
        for r in strong.toLocalIterator():
            known[r["pattern"]] = max(known.get(r["pattern"], (0.0, "")), (r["confidence"], r["as_kind"]))
        out = docs.mapInArrow(_masker(docs.sparkSession.sparkContext.broadcast(known)), docs.schema)
    else:
        at = found.select("text_key", "start", "end", "kind", F.explode("patterns").alias("pattern")).join(strong, "pattern", "left")
        kinds = at.groupBy("text_key", "start", "end", "kind").agg(F.max(F.struct("confidence", "as_kind")).alias("best"))
        kinds = kinds.select("text_key", "start", "end", F.coalesce("best.as_kind", "kind").alias("kind")).where("kind <> ''")
        key, name = free_name(docs, "__key"), free_name(docs, "__spans")
        spans = kinds.groupBy(F.col("text_key").alias(key)).agg(F.collect_set(F.struct("start", "end", "kind")).alias(name))
        joined = docs.withColumn(key, F.xxhash64("text")).join(spans, key, "left").drop(key)
        out = joined.mapInArrow(_masker(None, name), docs.schema)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
