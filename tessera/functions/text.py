"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cite_slug(c: Column) -> Column:
    """Runs of other characters than ASCII letters and digits become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def case_slug(c: Column, most: int = 120) -> Column:
    """Lower case, no punctuation, blanks and dashes as one underscore, at most `most` characters."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "_"), "^_+|_+$", ""), 1, most)


def strip_html(c: Column) -> Column:
    """Tags become blanks, &amp; an ampersand, other named entities blanks."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(out, "&amp;", "&"), "&[a-z]+;", " ")


def page_text(c: Column) -> Column:
    """Text of a page without scripts and styles, blanks collapsed."""
    bare = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(strip_html(bare), "[ \\t\\r\\n]+", " "))


def plain_quotes(c: Column) -> Column:
    """Typographic quotes and dashes as ASCII ones."""
    return F.translate(c, "‘’“”—–", "''\"\"--")


def quote_norm(c: Column) -> Column:
    """Letters and digits of a quotation for fuzzy comparison; what is between them is one blank, in one pass over a long text."""
    return F.trim(F.regexp_replace(F.lower(strip_html(c)), "[^a-z0-9]+", " "))


def bracket_norm(c: Column) -> Column:
    """Bracketed insertions and spaced ellipses dropped, punctuation as blanks, lower case."""
    out = F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", " "), r"\.\s*\.\s*\.", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.lower(F.regexp_replace(out, r"\s+", " ")))


def verbatim_norm(c: Column) -> Column:
    """Quotes as ASCII ones and blanks collapsed; the case stays."""
    return F.trim(F.regexp_replace(F.translate(c, "‘’“”", "''\"\""), r"\s+", " "))


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle, case and blanks folded."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    t, n = fold(text), fold(needle)
    hits = (F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)
    return F.when(F.length(n) > 0, hits.cast("int")).otherwise(0)


CITATION = r"\b(\d{1,4})\s+([A-Za-z][A-Za-z0-9.\s]*?)\s+(\d{1,7})\b"


def citation_parts(c: Column) -> tuple[Column, Column, Column]:
    """Volume, reporter and page of a citation; null where there is none."""
    part = lambda k: F.nullif(F.regexp_extract(c, CITATION, k), F.lit(""))
    return part(1), F.trim(F.regexp_replace(part(2), r"\s+", " ")), part(3)


def year_of(c: Column) -> Column:
    """First year from 1950 to 2029."""
    return F.expr("int(null)") if c is None else F.nullif(F.regexp_extract(c, r"\b(19[5-9]\d|20[0-2]\d)\b", 1), F.lit("")).cast("int")


def clock_seconds(c: Column) -> Column:
    """Seconds of MM:SS or H:MM:SS; null for other shapes."""
    parts = F.split(F.trim(c), ":")
    total = F.aggregate(F.transform(parts, lambda x: x.cast("int")), F.lit(0), lambda a, x: a * 60 + x)
    return F.when(F.trim(c).rlike(r"^\d{1,3}:\d{1,2}(:\d{1,2})?$"), total)


def clock_text(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def iso_date(c: Column) -> Column:
    """YYYYMMDD as an ISO date, else empty."""
    ok = F.when(c.rlike(r"^\d{8}$"), F.date_format(F.try_to_date(c, "yyyyMMdd"), "yyyy-MM-dd"))
    return F.coalesce(ok, F.lit(""))


def iso_or_empty(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c).otherwise("")


def safe_cell(c: Column, most: int) -> Column:
    """Truncated, defused against spreadsheet formulas, with table and HTML marks escaped."""
    out = F.substring(F.coalesce(c, F.lit("")), 1, most)
    out = F.when(out.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), out)).otherwise(out)
    for a, b in (("|", "\\|"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def caption_text(c: Column) -> Column:
    """Spoken text of a WebVTT or SRT file: no header, cue times, counters or tags."""
    lines = F.transform(F.split(c, "\r?\n"), lambda x: F.trim(x))
    said = F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    bare = F.transform(said, lambda x: F.regexp_replace(x, "<[^>]+>", ""))
    return F.array_join(F.filter(bare, lambda x: x != ""), " ")


def content_words(c: Column) -> Column:
    """Distinct lower-case words of two characters or more."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def error_rate(truth: Column, got: Column) -> Column:
    """Edit distance over the length of the truth, 1 at least."""
    return F.levenshtein(truth, got) / F.greatest(F.length(truth), F.lit(1))


def first_match(c: Column, rules: list[tuple[str, str]], rest: str | Column) -> Column:
    """Label of the first pattern that is found in the folded text."""
    low, out = F.lower(c), F
    for pattern, label in rules:
        out = out.when(low.rlike(pattern), label)
    return out.otherwise(rest)


#: Filing classes in the order in which their patterns are tried.
FILING_RULES = [
    (r"motion to dismiss|12\(b\)", "Motion to Dismiss"),
    ("motion for summary judgment|summary judgment", "Motion for Summary Judgment"),
    ("motion in limine", "Motion in Limine"),
    ("complaint|petition", "Complaint/Petition"),
    ("answer|response to complaint", "Answer"),
    ("order|opinion", "Order/Opinion"),
    ("scheduling order|case management", "Scheduling/CMO"),
    (r"stipulation|stip\.", "Stipulation"),
    ("notice of appeal|appeal", "Appeal"),
    ("subpoena", "Subpoena"),
    ("deposition", "Deposition Notice"),
    ("discovery", "Discovery"),
    ("trial", "Trial-Related"),
    ("hearing", "Hearing Notice"),
    ("judgment|decree", "Judgment"),
    ("settlement", "Settlement"),
]
#: Phrases that fire, suggest or skip a council, and the stakes that a suggestion needs.
FIRE = [r"\bcouncil this\b", r"\brun the council\b", r"\bwar[\s-]?room this\b", r"\bpressure[\s-]?test this\b", r"\bstress[\s-]?test this\b", r"\bdebate this\b"]
SUGGEST = [r"should i \w+ or \w+", "which option", "what would you do", "is this the right move", "validate this", "multiple perspectives", "can'?t decide", "torn between"]
SKIP = [r"\b(what is|define|spell|capital of|how do you spell)\b", r"^(yes|no|maybe|ok|thanks)\b"]
STAKES = [r"\$[\d,]+", r"\b(client|filing|deadline|trial|deposition|settle|sanction)\b"]
#: Marks of negative treatment, and those of them that make a source unusable.
NEGATIVE = [r"\boverruled\b", r"\babrogated\b", r"\bcalled into doubt\b", r"\bdistinguished\b", r"\bcriticized\b", r"\bno longer good law\b"]
FATAL = "overruled|abrogated|no longer good law"


def any_of(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def council_trigger(message: Column, source: Column) -> Column:
    """fire, suggest or skip."""
    low = F.lower(message)
    stakes = any_of(low, STAKES) | (F.length(message) > 200)
    return F.when(source == "sidebar", "fire").when(any_of(low, FIRE), "fire").when(any_of(low, SKIP), "skip").when(any_of(low, SUGGEST) & stakes, "suggest").otherwise("skip")


def treatment_signal(texts: Column) -> tuple[Column, Column]:
    """green, yellow or red, and up to five mentions. A mention is cut to 200 characters before the test for red, and a
    text counts once for each pattern that it meets."""
    found = F.flatten(F.transform(texts, lambda t: F.flatten(F.array(*(F.when(F.lower(t).rlike(p), F.array(F.substring(F.trim(t), 1, 200))).otherwise(F.array().cast("array<string>")) for p in NEGATIVE)))))
    red = F.exists(found, lambda m: F.lower(m).rlike(FATAL))
    return F.when(red, "red").when(F.size(found) > 0, "yellow").otherwise("green"), F.slice(found, 1, 5)


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two strings' character pairs, counted with multiplicity; 0 where one has none."""
    low = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    pairs = lambda c: F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    # an argument of a lambda is computed once, an expression inside of one each time
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    times = lambda v, p: F.size(v) - F.size(F.array_remove(v, p))

    def dice(s: Column) -> Column:
        x, y = s["x"], s["y"]
        common = F.aggregate(F.transform(F.array_intersect(x, y), lambda p: F.least(times(x, p), times(y, p))), F.lit(0), lambda t, n: t + n)
        return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * common / (F.size(x) + F.size(y))).otherwise(F.when(s["same"], 1.0).otherwise(0.0))

    cut = once(F.struct(low(a).alias("a"), low(b).alias("b")), lambda s: F.struct(pairs(s["a"]).alias("x"), pairs(s["b"]).alias("y"), (s["a"] == s["b"]).alias("same")))
    return once(cut, dice)


#: Intents of a message in the order in which their patterns are tried, then the patterns that tell specialties apart.
SHORT_MESSAGE = 80
INTENT_RULES = [
    (r"^(hi|hello|hey|thanks|thank you)\b", "simple"),
    (r"^(what (does|is)|define|how do i spell|explain|what is)\b", "simple"),
    (r"\b(summarize|summary|what (is|was) the holding|explain the (holding|case|decision))\b", "simple"),
    (r"\b(edit|proofread|rewrite|writing|brief check|improve my|review my (brief|motion|memo|letter)|badverbs|zombie nouns|persuasive writing)\b", "writing_coach"),
    (r"\b(deposition|depose|impeach|contradict|cross.?exam|prior testimony|inconsisten|conflict(s| in)|what did.*say|witness.*said)\b", "impeacher"),
    (r"\b(defense theory|their argument|what will they argue|opposition map|counter.*argument|pre.?existing|sudden emergency|comparative fault|low.?impact|map.*defense|defense.*map)\b", "opposition_map"),
    (r"\b(infringement|infringe|trademark dispute|copyright claim|patent claim|trade secret|stolen (idea|invention|code|design)|copying (my|our)|dmca|likelihood of confusion|triage|ip (issue|problem|dispute|violation))\b", "ip_triage"),
    (r"\b(ip clause|assignment (clause|gap|provision)|work.?for.?hire|open source (clause|risk|license|exposure)|confidentiality clause|intellectual property (clause|provision)|review.*(?:ip|assignment|license)|license (grant|scope|restriction))\b", "ip_clause_review"),
    (r"\b(dmca (notice|takedown|counter|letter)|takedown notice|counter.?notice|section 512|§\s?512|512[cg]|copyright (notice|complaint|claim))\b", "dmca_takedown"),
    (r"\b(va (claim|rating|disability|benefit|appeal|decision)|veteran('s)? (benefit|health|disability|claim|appeal)|bva|cavc|38 (usc|cfr)|service.?connect|individual unemployability|cue (error|claim)|notice of disagreement)\b", "specialty"),
    (r"\b(security clearance|clearance (denied|revoked|appeal|hearing)|doha|iscr|sf.?86|adjudicative guideline|foreign influence|whole person|sar access|sap access|ts.?sci|special access program)\b", "specialty"),
    (r"\b(howey test|token (classification|security|commodity)|sec.*token|cftc.*crypto|defi (liability|regulation)|nft (security|regulation)|bitcoin (security|commodity)|digital asset (law|regulation|compliance)|blockchain (law|regulation))\b", "specialty"),
    (r"\b(talent agenc|talent representation|7.?year rule|recording contract|360 deal|controlled composition|sync licens|master licens|right of publicity|sampling (clearance|infringement|license)|guild (minimum|agreement|residual)|sag.?aftra|wga|dga)\b", "specialty"),
    (r"\b(ai (liability|copyright|training data|act compliance|regulation|ethics)|eu ai act|training data (copyright|infringement|fair use)|ai.?generated (copyright|ownership|authorship)|algorithmic (bias|accountability|discrimination)|llm (liability|copyright)|foundation model (compliance|regulation))\b", "specialty"),
]
SPECIALTY_RULES = [
    (r"\b(va |veteran|bva|cavc|38 (usc|cfr)|service.?connect|unemployability|cue (error|claim)|notice of disagreement)\b", "veterans_health"),
    (r"\b(security clearance|doha|iscr|sf.?86|adjudicative|foreign influence|sar access|sap access|ts.?sci)\b", "security_clearance"),
    (r"\b(howey|token (class|secur)|sec.*token|cftc.*crypto|defi |nft (secur|reg)|digital asset|blockchain (law|reg))\b", "crypto_howey"),
    (r"\b(talent agenc|talent rep|7.?year rule|recording contract|360 deal|controlled comp|sync licens|master licens|right of publicity|sampling |guild |sag.?aftra|wga |dga )\b", "entertainment_talent"),
    (r"\b(ai (liabil|copyright|training|act compli|regulat|ethics)|eu ai act|training data|ai.?generat|algorithmic (bias|account|discrimin)|llm |foundation model)\b", "ai_legal_tech"),
]


def message_intent(message: Column, has_document: Column) -> tuple[Column, Column]:
    """(intent, specialty) of a message: short ones are simple, then the first rule, then whether a document came with it."""
    said = F.trim(F.coalesce(message, F.lit("")))
    rest = F.when(has_document, "full_crew").otherwise("research_only")
    intent = F.when(F.length(said) < SHORT_MESSAGE, "simple").otherwise(first_match(said, INTENT_RULES, rest))
    return intent, F.when(intent == "specialty", first_match(said, SPECIALTY_RULES, SPECIALTY_RULES[-1][1]))


#: What a quote and a cite look like in a dictionary's entries, and how many cites are kept.
DICTIONARY_QUOTE = '"([^"]{20,500})"'
DICTIONARY_CITE = r"\b(\d+\s+(?:U\.S\.|S\.\s*Ct\.|F\.\d*[a-z]*|F\.\s*Supp\.?\s*\d*|L\.\s*Ed\.?\s*\d*)\s+\d+)"
DICTIONARY_CITES = 5


def dictionary_entries(markdown: Column) -> Column:
    """array<struct(term, quote, cites)> of the '## ' sections of a text that have both a quote and a cite: the heading, the first
    quote, and the first cites."""

    def entry(block: Column) -> Column:
        lines = F.split(F.trim(block), "\n", 2)
        body = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
        quote = F.regexp_extract(body, DICTIONARY_QUOTE, 1)
        cites = F.slice(F.regexp_extract_all(body, F.lit(DICTIONARY_CITE), F.lit(1)), 1, DICTIONARY_CITES)
        return F.struct(F.trim(F.get(lines, F.lit(0))).alias("term"), quote.alias("quote"), cites.alias("cites"))

    blocks = F.split(markdown, "\n## ")
    return F.filter(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), entry), lambda e: (e["quote"] != "") & (F.size(e["cites"]) > 0))
