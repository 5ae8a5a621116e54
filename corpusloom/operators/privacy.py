"""Visibility decisions, policy and redaction (R, P18-P24)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import replace_inline
from .ranking import latest_by

#: Labels of redacted spans by the category of a finding.
LABELS = {
    "credentials": "credential",
    "personal_data": "personal data",
    "personnel": "personnel matter",
    "individual_assessment": "assessment of a person",
    "security": "security detail",
    "other": "sensitive detail",
}
#: Words by which a restricted finding is a notice.
NOTICE_WORDS = (
    r"proprietar|confidential|vertraulich|internal|distribut|export|\bitar\b|\bear\b"
    r"|official\s+use|\bouo\b|\bcui\b|\bnda\b|non-disclosure|forbidden|embargo|reproduc|restricted"
)
#: Families of restriction markings, with severity and pattern.
MARKERS = {
    "proprietary notice": ("medium", r"(?i)proprietary\s+(?:information|data|notice|(?:and|&)\s+confidential)\b|proprietary\s+to\s+\w|contains\s+(?:information|data)\s+(?:that\s+is\s+)?proprietary|considered\s+(?:to\s+be\s+)?proprietary"),
    "official use only": ("high", r"(?i)official\s+use\s+only|\(OUO\)"),
    "CUI banner": ("high", r"\bCUI\s*//\s*\w+"),
    "export control": ("high", r"(?i)export[- ]controlled|subject\s+to\s+(?:the\s+)?(?:ITAR|EAR)\b|ITAR[- ]controlled|\bECCN\b\W{0,5}(?!EAR99)[0-9][A-E][0-9]{3}"),
    "confidentiality notice": ("medium", r"(?i)\b(?:company|strictly|highly)\s+confidential\b|\bvertraulich\b|\bdo\s+not\s+(?:distribute|forward|copy)\b|\bnot\s+for\s+(?:public\s+)?(?:distribution|release)\b|\binternal\s+use\s+only\b|\b(?:collaboration)[- ]internal\s+only\b|\binternal\s+to\s+the\s+collaboration\b"),
}
#: Words in lower case, one of which stands in each text with a marking of the family, so that others needn't be looked through.
MARKER_WORDS = {
    "proprietary notice": ("proprietary",),
    "official use only": ("official", "(ouo)"),
    "CUI banner": ("cui",),
    "export control": ("controlled", "subject", "eccn"),
    "confidentiality notice": ("confidential", "vertraulich", "distribut", "forward", "copy", "release", "internal"),
}
#: A byte of an address, and what stands after a key word without being a secret.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NOT_A_SECRET = r"(?!\[redacted|<|\*{3}|x{3}|none\b|n/?a\b|your\b|the\b|is\b|required\b|same\b|see\b|tbd\b)"
#: Fixed values (U7): label, pattern, and whether its group, with which a match ends, is what goes.
PATTERNS = [
    ("meeting passcode", r"[?&]pwd=([A-Za-z0-9._\-]{6,}(?:\s(?=[A-Za-z._\-]*\d)[A-Za-z0-9._\-]{4,})?)", True),
    ("credential", r"(?i)(?:\b(?:pass\s?code|password|passwd|pwd)\b\s*[:=]|\bpw\s*:)\s*" + _NOT_A_SECRET + r"([^\s,;\"'<>()\[\]]{3,40})", True),
    ("credential", r"\bPIN\s*[:=]\s*(\d{4,8})\b", True),
    ("payment card", r"\bCard#\s?[A-Z][A-Z0-9]{1,15}(?:[\s|]+\d{4})?\b", False),
    ("private key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", False),
    ("network address", r"(?<![\d.])(?:10\." + _OCTET + r"|172\.(?:1[6-9]|2\d|3[01])|192\.168)\." + _OCTET + r"\." + _OCTET + r"(?::\d{2,5})?(?![\d.]*\d)", False),
    ("hardware address", r"(?<![0-9A-Fa-f:-])(?:(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?=[0-9-]*[A-Fa-f])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2})(?![0-9A-Fa-f:-])", False),
    ("access token", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", False),
]


def current_visibility(decisions: DataFrame) -> DataFrame:
    """The decision with the highest seq for each (raw_id, group), whatever order they came in."""
    return latest_by(decisions, ["raw_id", "group"], ["seq"])


def name_rule(patterns: Sequence[str] = (), titles: Sequence[str] = (), exclude: Sequence[str] = (), packages: Sequence[tuple[Sequence[str], Sequence[str]]] = ()) -> Column:
    """R2: doc_id or title matches any pattern (case-insensitive LIKE), or both those of a package (titles, files), and doc_id no exclusion.

    A null doc_id or title matches nothing.
    """
    like = lambda column, those: reduce(or_, [F.coalesce(F.col(column), F.lit("")).ilike(p) for p in those], F.lit(False))
    hit = like("doc_id", patterns) | like("title", titles)
    for entry_titles, files in packages:
        hit = hit | (like("title", entry_titles) & like("doc_id", files))
    return hit & ~like("doc_id", exclude)


def visibility_sweep(raw: DataFrame, rule: Column, decided: DataFrame) -> DataFrame:
    """Counts of matched, decided by a person, and pending rows."""
    human = decided.where("origin = 'human'").select("raw_id").distinct().withColumn("__h", F.lit(True))
    m = raw.where(rule).join(human, "raw_id", "left")
    return m.agg(F.count(F.lit(1)).alias("matched"), F.count("__h").alias("decided"), F.count_if(F.col("__h").isNull()).alias("pending"))


def span_pattern(span: Column) -> Column:
    """The pattern of a phrase: any white space between its words, any case, whole words; null for no words.

    A phrase of seven digits or more and separators is a phone number: its digits with any separators in between.
    """
    flat = F.trim(F.regexp_replace(span, r"(?U)\s+", " "))
    digits = F.regexp_replace(flat, r"\D", "")
    # fixed values: the signs that may stand between the digits of a telephone number, and its edges
    phone = F.concat(F.lit(r"(?<!\d)\(?"), F.array_join(F.filter(F.split(digits, ""), lambda x: x != ""), r"[\s\-.()/]*"), F.lit(r"(?!\d)"))
    words = F.transform(F.split(flat, " "), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    edge = lambda c, mark: F.when(c.rlike(r"[\p{L}\p{N}_]"), mark).otherwise("")
    text = F.concat(F.lit("(?iU)"), edge(F.left(flat, F.lit(1)), r"(?<!\w)"), F.array_join(words, r"\s+"), edge(F.right(flat, F.lit(1)), r"(?!\w)"))
    is_phone = flat.rlike(r"^\+?[\d\s\-.()/]+$") & (F.length(digits) >= 7)
    return F.when(flat != "", F.when(is_phone, phone).otherwise(text))


def policy_actions(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """What the policy does about each document: id, hide_search, hide_get, redact (spans with labels), flag.

    findings has id, category, severity, span, evidence, source and covered (P24); docs has id and text. Findings that a
    redaction covers are left alone unless their rule is to hide. A span is exact if its pattern (P23) stands in the text.
    - restricted: hidden if a marker or a notice word says so, else flagged
    - credentials: high: redacted and flagged, hidden without an exact span; medium: redacted, else flagged
    - personal data, personnel, assessments: high: hidden from search, and redacted; personal data, medium: redacted
    - anything else from medium on is flagged; low does nothing
    """
    f = findings.where(F.col("severity").isin("medium", "high")).join(docs.select("id", "text"), "id")
    span = F.trim(F.regexp_replace(F.coalesce("span", F.lit("")), r"\s+", " "))
    f = f.withColumn("span", span).withColumn("pattern", span_pattern(F.col("span")))
    exact = (F.length("span") >= 4) & F.col("span").rlike(r"[\p{L}\p{N}]") & F.coalesce(F.regexp_like("text", F.col("pattern")), F.lit(False))
    high, kind = F.col("severity") == "high", F.col("category")
    about_people = kind.isin("personal_data", "personnel", "individual_assessment") & high
    f = f.withColumn("exact", exact).where((kind == "restricted") | about_people | ~F.coalesce("covered", F.lit(False)))
    notice = (F.coalesce("source", F.lit("")) == "marker") | F.concat_ws(" ", "span", "evidence").rlike(f"(?i){NOTICE_WORDS}")
    secret = kind == "credentials"
    hide_all = ((kind == "restricted") & notice) | (secret & high & ~F.col("exact"))
    redact = F.col("exact") & (secret | about_people | (kind == "personal_data"))
    quiet = hide_all | about_people | (redact & ~(secret & high))
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), kind), F.lit("sensitive detail"))
    f = f.select("id", hide_all.alias("all"), (hide_all | about_people).alias("search"), F.when(redact, F.struct(F.lower("span").alias("span"), label.alias("label"))).alias("r"), (~quiet).alias("flag"))
    return f.groupBy("id").agg(F.bool_or("search").alias("hide_search"), F.bool_or("all").alias("hide_get"), F.array_sort(F.collect_set("r")).alias("redact"), F.bool_or("flag").alias("flag"))


def apply_policy(current: DataFrame, actions: DataFrame, scans: DataFrame) -> DataFrame:
    """New decisions (raw_id, old_state, new_state, hide_search, hide_get) of documents whose state the policy changes.

    current has raw_id, origin and state; actions (R4) has raw_id, hide_search, hide_get; scans has raw_id and scannable.
    Decisions of people never change. What can't be scanned is hidden from both; what is to be hidden gets a provisional
    decision; a hold on a scanned document with nothing to hide is lifted, and one without a scan stays.
    """
    rows = current.join(actions, "raw_id", "left").join(scans, "raw_id", "left").where("coalesce(origin, '') <> 'human'")
    blind = F.col("scannable").isNotNull() & ~F.col("scannable")
    search, get = (F.coalesce(c, F.lit(False)) | blind for c in ("hide_search", "hide_get"))
    new = F.when(search | get, "provisional").when((F.col("state") == "held") & F.col("scannable"), "visible").otherwise(F.col("state"))
    out = rows.select("raw_id", F.col("state").alias("old_state"), new.alias("new_state"), search.alias("hide_search"), get.alias("hide_get"))
    return out.where("not (old_state <=> new_state)")


def hold_new(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision to hold each raw document that has none yet."""
    return raw.select("raw_id").distinct().join(decisions.select("raw_id"), "raw_id", "left_anti").withColumn("state", F.lit("held"))


def review_queue(current: DataFrame, flagged: DataFrame) -> DataFrame:
    """Held, provisional and flagged documents with their section."""
    part = lambda state: current.where(F.col("state") == state).select("raw_id", F.lit(state).alias("section"))
    return part("held").unionByName(part("provisional")).unionByName(flagged.select("raw_id", F.lit("flagged").alias("section")))


def find_markers(docs: DataFrame, families: Mapping[str, tuple[str, str]] | None = None, most: int = 3, context: int = 80) -> DataFrame:
    """Restriction markings (id, family, severity, wording, span, evidence): distinct wordings of each family, most of each.

    A wording is the match in lower case with white space squeezed; span is its first match as it stands, and evidence
    the first match with context characters on either side, squeezed.
    """
    out = []
    for name, (severity, pattern) in (MARKERS if families is None else families).items():
        may = reduce(or_, [F.contains("__low", F.lit(w)) for w in MARKER_WORDS[name]]) if families is None else None
        spans = F.transform(pattern_spans(F.col("text"), F.lit(pattern), may=may), lambda s, i: F.struct(F.substring("text", s["begin"] + 1, s["end"] - s["begin"]).alias("span"), s["begin"].alias("begin"), s["end"].alias("end")))
        squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
        named = F.transform(spans, lambda s: F.struct(F.lower(squeeze(s["span"])).alias("wording"), s.alias("at")))
        words = lambda n: F.slice(F.array_distinct(F.transform(n, lambda x: x["wording"])), 1, most)
        # taken up as one value, so that the matches aren't found anew for each wording
        first = F.flatten(F.transform(F.array(named), lambda n: F.transform(words(n), lambda w: F.get(F.filter(n, lambda x: x["wording"] == w), F.lit(0)))))
        begin = lambda x: F.greatest(x["at"]["begin"] - context, F.lit(0))
        evidence = lambda x: F.left(squeeze(F.substring("text", begin(x) + 1, x["at"]["end"] + context - begin(x))), F.lit(300))
        out.append(F.transform(first, lambda x: F.struct(F.lit(name).alias("family"), F.lit(severity).alias("severity"), x["wording"].alias("wording"), x["at"]["span"].alias("span"), evidence(x).alias("evidence"))))
    rows = docs.select("id", "text", F.lower("text").alias("__low")) if families is None else docs
    return rows.select("id", F.inline(F.flatten(F.array(*out))))


def pattern_spans(text: Column, pattern: Column, last_group: bool = False, may: Column | None = None) -> Column:
    """(begin, end) of each match of a pattern in a text, from 0; of its last group, with which a match ends, if last_group.

    may, if given, is false only for texts without a match.
    """
    # taken from the text once, as one value, and only where there is a match at all
    held = {"between": F.split(text, pattern, -1), "found": F.regexp_extract_all(text, pattern, F.lit(0))}
    if last_group:
        held["part"] = F.regexp_extract_all(text, pattern, F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((end - F.length(x["part"])).alias("begin"), end.alias("end")))).alias("out"))

    def spans(h: Column) -> Column:
        part = h["part"] if last_group else h["found"]
        rows = F.arrays_zip(F.slice(h["between"], F.lit(1), F.size(h["found"])).alias("gap"), h["found"].alias("found"), part.alias("part"))
        return F.filter(F.aggregate(rows, start, add, lambda acc: acc["out"]), lambda s: s["end"] > s["begin"])

    once = F.array(F.struct(*[c.alias(n) for n, c in held.items()]))
    some = F.rlike(text, pattern) if may is None else may & F.rlike(text, pattern)
    return F.when(some, F.flatten(F.transform(once, spans))).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))


def find_replacements(text: Column, rules: Column | None = None, patterns: Sequence[tuple[str, str, bool]] | None = None) -> Column:
    """The parts (begin, end, label) of a text to replace, in order and apart from each other.

    rules is an array of (pattern, label), as span_pattern() makes them, and goes first; patterns has (label, pattern, whether its group
    stands for the match). Where parts overlap they become one, with the label of the one that begins first, then of the longer one.
    """

    def ranked(found: Column, label: Column, priority: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["begin"].alias("begin"), (-s["end"]).alias("minus_end"), priority.cast("int").alias("priority"), label.alias("label")))

    every = [ranked(pattern_spans(text, F.lit(p), group), F.lit(label), F.lit(1000 + i)) for i, (label, p, group) in enumerate(PATTERNS if patterns is None else patterns)]
    if rules is not None:
        every.append(F.flatten(F.transform(rules, lambda r, i: ranked(pattern_spans(text, r["pattern"]), r["label"], i))))
    sorted_ = F.array_sort(F.flatten(F.array(*every)))

    def add(acc: Column, x: Column) -> Column:
        last, end = F.element_at(acc, -1), -x["minus_end"]
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["begin"].alias("begin"), end.alias("end"), last["label"].alias("label"))))
        fresh = F.concat(acc, F.array(F.struct(x["begin"].alias("begin"), end.alias("end"), x["label"].alias("label"))))
        return F.when((F.size(acc) > 0) & (x["begin"] < last["end"]), F.when(end > last["end"], wider).otherwise(acc)).otherwise(fresh)

    return F.aggregate(sorted_, F.array().cast("array<struct<begin:int,end:int,label:string>>"), add)


def _placeholder(r: Column) -> Column:
    return F.concat(F.lit("[redacted: "), r["label"], F.lit("]"))


def apply_replacements(text: Column, replacements: Column) -> Column:
    """Text with its replacements in place."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    add = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, r["begin"] - acc["at"]), _placeholder(r)).alias("out"))
    return F.aggregate(replacements, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def map_offset(replacements: Column, at: Column, end: bool = False) -> Column:
    """Where a position of the original text is in the redacted one; within a part, its placeholder's start, or its end."""
    size = lambda r: F.length(_placeholder(r))

    def add(acc: Column, r: Column) -> Column:
        inside = (at > r["begin"]) & (at < r["end"])
        within = r["begin"] + acc["shift"] + (size(r) if end else F.lit(0))
        moved = F.when(at >= r["end"], acc["shift"] + size(r) - (r["end"] - r["begin"])).otherwise(acc["shift"])
        return F.struct(moved.alias("shift"), F.coalesce(acc["place"], F.when(inside & (at > r["begin"]), within)).alias("place"))

    start = F.struct(F.lit(0).alias("shift"), F.lit(None).cast("int").alias("place"))
    return F.aggregate(replacements, start, add, lambda acc: F.coalesce(acc["place"], at + acc["shift"]))


def redact(c: Column, rules: Column | None = None, patterns: Sequence[tuple[str, str, bool]] | None = None) -> Column:
    """A text with all that rules and patterns find replaced by [redacted: label]; a second run changes nothing."""
    return apply_replacements(c, find_replacements(c, rules, patterns))


def rules_of(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Docs (id, raw_id, ...) with rules, an array of (pattern, label), for find_replacements().

    rules has rule_id, raw_id, span and label; a rule without raw_id holds for all documents. Spans without words are no rules. A document's own
    rules come first. Of rules with one pattern, which find the same parts, only the first is there: it gives the label.
    """
    made = rules.select("rule_id", "raw_id", span_pattern(F.col("span")).alias("pattern"), "label").where("pattern is not null")
    made = made.groupBy("raw_id", "pattern").agg(F.min(F.struct("rule_id", "label")).alias("r")).select("r.rule_id", "raw_id", "pattern", "r.label")
    as_list = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "pattern", "label"))), lambda x: F.struct(x["pattern"].alias("pattern"), x["label"].alias("label")))
    own = made.where("raw_id is not null").groupBy("raw_id").agg(as_list.alias("__own"))
    common = made.where("raw_id is null").agg(as_list.alias("__all"))  # one row
    out = docs.join(own, "raw_id", "left").crossJoin(F.broadcast(common))
    return out.withColumn("rules", F.concat(F.coalesce("__own", F.array().cast("array<struct<pattern:string,label:string>>")), "__all")).drop("__own", "__all")


def split_windows(docs: DataFrame, window: int = 24_000, overlap: int = 800) -> DataFrame:
    """(id, window, text): texts in windows of at most window characters, each beginning overlap before the end of the last.

    A window ends behind a paragraph, else a line, within its last fifth, else where it is full. A text that fits is one window;
    a null one is empty.
    """
    if window * 4 // 5 <= overlap:
        raise ValueError("a window must be more than five quarters of the overlap")

    def cuts(text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > window:
            low, end = start + window * 4 // 5, start + window
            at = text.rfind("\n\n", low, end - 1)
            line = text.rfind("\n", low, end)
            stop = at + 2 if at >= 0 else line + 1 if line >= 0 else end
            yield text[start:stop]
            start = stop - overlap
        yield text[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, t) for i, text in enumerate(b.column("text").to_pylist()) for k, t in enumerate(cuts(text or ""))]
            ids = b.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": ids, "window": pa.array([r[1] for r in rows], pa.int32()), "text": pa.array([r[2] for r in rows], pa.string())})

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, window int, text string")


def parse_findings(replies: DataFrame) -> DataFrame:
    """Replies (id, window, reply) of a model as findings: id, window, category, severity, span, evidence, reason, bad.

    A reply is a JSON object with findings, bare or in a fence or amid other text. Unknown categories become other, unknown
    severities low; span is cut to 200 characters, evidence to 300, reason to 300. A reply that can't be read gives one row with bad.
    """
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    kind = "struct<findings:array<struct<category:string,severity:string,span:string,evidence:string,reason:string>>>"
    rows = replies.select("id", "window", F.from_json(body, kind).alias("r"))
    rows = rows.select("id", "window", F.col("r.findings").isNull().alias("bad"), F.explode_outer("r.findings").alias("f")).where("bad or f is not null")
    category, severity = (F.lower(F.trim(F.coalesce(f"f.{c}", F.lit("")))) for c in ("category", "severity"))
    known = [*LABELS, "restricted"]
    return rows.select(
        "id", "window", F.when(~F.col("bad"), F.when(category.isin(*known), category).otherwise("other")).alias("category"),
        F.when(~F.col("bad"), F.when(severity.isin("medium", "high"), severity).otherwise("low")).alias("severity"),
        *[F.left(f"f.{c}", F.lit(n)).alias(c) for c, n in (("span", 200), ("evidence", 300), ("reason", 300))], "bad",
    )


def sensitivity_scan(docs: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, window: int = 24_000, overlap: int = 800) -> DataFrame:
    """A row for each document: id, windows, findings, max_severity.

    Windows of a text (P19) go to score, which gives findings (id, severity, ...); by default those are its restriction markings (P18) and what
    the redaction patterns find (P21, medium). Findings that overlapping windows repeat count once.
    """
    parts = split_windows(docs, window, overlap)
    if score is None:
        marks = find_markers(parts).select("id", "severity", F.col("family").alias("what"), "wording")
        hits = parts.select("id", F.explode(find_replacements(F.col("text"))).alias("r"), "text")
        found = marks.union(hits.select("id", F.lit("medium"), "r.label", F.expr("substring(text, r.begin + 1, r.end - r.begin)"))).distinct()
    else:
        found = score(parts)
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    found = found.groupBy("id").agg(F.count(F.lit(1)).alias("findings"), F.max(rank).alias("worst"))
    out = parts.groupBy("id").agg(F.count(F.lit(1)).alias("windows")).join(found, "id", "left")
    return out.select("id", "windows", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.get(F.array(*map(F.lit, ("none", "low", "medium", "high"))), F.coalesce("worst", F.lit(0))).alias("max_severity"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans (id, begin, end, label, priority) as one, with the label of the one that begins first.

    Of those that begin together the longest gives the label, then the one of the first priority, then the first label.
    """
    first = F.struct("begin", -F.col("end"), "priority", "label")
    w = Window.partitionBy("id").orderBy("begin", F.desc("end"), "priority")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((F.col("begin") >= before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("id", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min_by("label", first).alias("label")).drop("island")


def finding_covered(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings (id, finding_id, begin, end) with whether one span of their document covers them."""
    s = spans.select("id", F.col("begin").alias("b"), F.col("end").alias("e"))
    hit = findings.join(s, "id").where("b <= begin and e >= end").select("finding_id").distinct().withColumn("covered", F.lit(True))
    return findings.join(hit, "finding_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def redaction_candidates(findings: DataFrame, docs: DataFrame, floor: int) -> DataFrame:
    """Spans of uncovered findings of a severity that occur in their text, one for each wording."""
    f = findings.where((F.col("severity") >= floor) & ~F.col("covered")).join(docs.select("id", "text"), "id")
    return f.where(F.contains("text", "span")).groupBy("id", F.lower("span").alias("span")).agg(F.max("severity").alias("severity"))


def excerpts(hits: DataFrame, context: int = 500) -> DataFrame:
    """Matched ranges (id, begin, end, n_chars) widened by context and merged in each document."""
    wide = hits.select("id", F.greatest(F.col("begin") - context, F.lit(0)).alias("begin"), F.least(F.col("end") + context, F.col("n_chars")).alias("end"), F.lit("x").alias("label"), F.lit(0).alias("priority"))
    return merge_spans(wide).drop("label")


def review_actions(actions: DataFrame, current: DataFrame) -> DataFrame:
    """Actions (raw_id, action) as decisions; only a provisional state can be confirmed, others are rejected."""
    a = actions.join(current.select("raw_id", "state"), "raw_id", "left")
    new = F.when((F.col("action") == "confirm") & (F.col("state") == "provisional"), "confirmed").when(F.col("action") == "show", "visible").when(F.col("action") == "hide", "hidden")
    return a.select("raw_id", "action", new.alias("new_state"), new.isNull().alias("rejected"))


#: Visibility rules by name: conditions on raw documents, for visibility_sweep().
VISIBILITY_RULES: dict[str, Column] = {}


def visibility_rule(name: str, rule: Column) -> Column:
    """Register a rule; a name can be taken once."""
    if name in VISIBILITY_RULES:
        raise ValueError(f"rule {name!r} is there already")
    VISIBILITY_RULES[name] = rule
    return rule


def apply_image_decisions(records: DataFrame, registry: DataFrame, parents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, parents, chunks) after the registry's decisions on images.

    records has id, image_hash, image_ref, parent_id, description, label; registry has image_hash, decorative, label. A decorative image is
    demoted: its description gives way to the label, which is kept beside it. One that isn't any more is restored. Parents (id, text) have the
    new description at its reference; chunks (id, ...) of changed records go, to be made anew.
    """
    r = records.join(registry.select("image_hash", "decorative", F.col("label").alias("__label")), "image_hash", "left")
    demote = F.coalesce(F.col("decorative"), F.lit(False)) & F.col("label").isNull()
    restore = F.col("decorative").isNotNull() & ~F.col("decorative") & F.col("label").isNotNull()
    r = r.withColumn("__changed", demote | restore).withColumn("shown", F.when(F.coalesce("decorative", F.lit(False)), F.coalesce("__label", "label")).otherwise(F.col("description")))
    after = r.withColumn("label", F.when(demote, F.col("__label")).when(restore, F.lit(None)).otherwise(F.col("label")))
    changed = after.where("__changed").select("id", "parent_id", "image_ref", "shown")
    swaps = changed.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("image_ref", "shown"))).alias("s"))
    text = F.aggregate("s", F.col("text"), lambda t, x: replace_inline(t, x["image_ref"], x["shown"]))
    new_parents = parents.join(swaps, "id", "left").withColumn("text", F.when(F.col("s").isNull(), F.col("text")).otherwise(text)).drop("s")
    return after.select(*records.columns), new_parents, chunks.join(changed.select("id"), "id", "left_anti")
