"""Scalar text functions as Column expressions: tokens, sentences, keys, titles, attribute rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and sentence patterns, word lists and curated terms of the domain.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9+.#/\-]*|[\x{4e00}-\x{9fff}]|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"
FEATURE_TOKEN = r"[a-z0-9][a-z0-9+.#/\-]*|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"
SENTENCE_END = "(?<=[。！？!?；;])\\s*|(?<=[.?!])\\s+"
LINE_SENTENCE_END = "(?<=[.!?])\\s+|\\r?\\n+"
PROFICIENCY_RULES = (
    ("expert", "expert"), ("proficient", "proficient"), ("experienced", "proficient"), ("familiar", "familiar"), ("basic", "basic"),
    ("advanced", "expert"), ("精通", "expert"), ("熟练", "proficient"), ("熟悉", "familiar"), ("了解", "basic"),
)
OPTIONAL_HINTS = ("preferred", "nice to have", "plus", "加分", "优先", "可选")
YEARS = r"([0-9]+(?:\.[0-9]+)?)\s*(years?|年)"
GENERIC_TITLES = ("junior", "middle", "middle+", "senior", "lead", "native", "remote")
GENERIC_TITLE_WORDS = ("software", "backend", "back end", "frontend", "front end", "full stack", "developer", "engineer")
ROLE_WORDS = ("administrator", "analyst", "architect", "consultant", "developer", "designer", "devops", "engineer", "manager", "qa", "scientist", "specialist", "sre", "tester")
MOJIBAKE = "�鈥鏈宸鏁绉"
GENERIC_TERMS = ("ability", "business", "development", "experience", "knowledge", "management", "requirements", "required", "skills", "software", "team", "work")
AMBIGUOUS_TERMS = ("access", "go", "office", "spring", "word")
INFRASTRUCTURE = ("AWS", "Azure", "Docker", "Kubernetes", "Terraform", "Ansible", "Linux")
#: raw term -> (entity type, label)
TECH_TERMS = {
    ".net": ("SKL", ".NET"), "c++": ("SKL", "C++"), "php": ("SKL", "PHP"), "java": ("SKL", "Java"), "python": ("SKL", "Python"),
    "javascript": ("SKL", "JavaScript"), "typescript": ("SKL", "TypeScript"), "c#": ("SKL", "C#"), "go": ("SKL", "Go"), "ruby": ("SKL", "Ruby"),
    "kotlin": ("SKL", "Kotlin"), "scala": ("SKL", "Scala"), "sql": ("SKL", "SQL"), "react": ("TOL", "React"), "react native": ("TOL", "React Native"),
    "angular": ("TOL", "Angular"), "vue": ("TOL", "Vue"), "spring": ("TOL", "Spring"), "django": ("TOL", "Django"), "flask": ("TOL", "Flask"),
    "laravel": ("TOL", "Laravel"), "node.js": ("TOL", "Node.js"), "nodejs": ("TOL", "Node.js"), "aws": ("TOL", "AWS"), "azure": ("TOL", "Azure"),
    "docker": ("TOL", "Docker"), "kubernetes": ("TOL", "Kubernetes"), "k8s": ("TOL", "Kubernetes"), "git": ("TOL", "Git"), "linux": ("TOL", "Linux"),
    "bash": ("TOL", "Bash"), "terraform": ("TOL", "Terraform"), "ansible": ("TOL", "Ansible"), "mysql": ("TOL", "MySQL"), "postgresql": ("TOL", "PostgreSQL"),
    "mongodb": ("TOL", "MongoDB"), "redis": ("TOL", "Redis"), "excel": ("TOL", "Excel"), "pytorch": ("TOL", "PyTorch"), "tensorflow": ("TOL", "TensorFlow"),
    "machine learning": ("KNW", "Machine Learning"), "data analysis": ("KNW", "Data Analysis"), "seo": ("KNW", "SEO"), "ppc": ("KNW", "PPC"),
}


def tokens(text: Column) -> Column:
    """Tokens: a run of ASCII letters and digits that ``+.#/-`` may continue, one CJK character, or one other sign."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def feature_tokens(text: Column) -> Column:
    """Lower-case tokens without CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(FEATURE_TOKEN), F.lit(0))


def token_offsets(text: Column, toks: Column) -> Column:
    """array<struct<start,end>> of tokens found one after the other; a token that isn't there sits at the cursor."""
    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, tok: Column) -> Column:
        start = F.greatest(F.call_function("locate", tok, text, acc["cursor"] + 1) - 1, acc["cursor"])
        end = start + F.length(tok)
        return F.struct(end.alias("cursor"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(toks, zero, step)["out"]


def _trimmed_parts(text: Column, pattern: str) -> Column:
    parts = F.filter(F.transform(F.split(text, pattern), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: s != "")
    return F.when(F.size(parts) == 0, F.array(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")))).otherwise(parts)


def sentences(text: Column) -> Column:
    """Trimmed sentences; a text without any is its own only sentence."""
    return _trimmed_parts(text, SENTENCE_END)


def line_sentences(text: Column) -> Column:
    """Sentences that line ends break too, blank ones dropped."""
    return F.filter(F.transform(F.split(text, LINE_SENTENCE_END), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: s != "")


def lookup_key(x: Column) -> Column:
    """Lower case, white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def name_key(x: Column) -> Column:
    """Lower case without white space, as queries compare names."""
    return F.regexp_replace(F.lower(x), r"(?U)\s+", "")


def align_key(x: Column) -> Column:
    """Lower case, only ``a-z0-9``, CJK and ``+.#`` left."""
    return F.regexp_replace(F.lower(x), r"[^a-z0-9\x{4e00}-\x{9fff}+.#]+", "")


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def occupation_slug(x: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(slug(x), 1, 80), F.lit("")), F.lit("unknown_role"))


def aliases(x: Column) -> Column:
    """Distinct trimmed parts of a ``|`` or ``;`` list, in order."""
    return F.array_distinct(alias_parts(x))


def alias_parts(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[|;]"), lambda s: F.trim(s)), lambda s: s != "")


def token_key(toks: Column) -> Column:
    """One string for a sequence of tokens in lower case."""
    return F.array_join(F.transform(toks, lambda t: F.lower(t)), "\x01")


def _contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])


def tech_label(x: Column) -> Column:
    """Label of the longest curated term that stands alone in a text, else null."""
    low = F.lower(x)
    found = [F.when(low.rlike(rf"(?<![a-z0-9+#.])\Q{raw}\E(?![a-z0-9+#.])"), F.lit(TECH_TERMS[raw][1])) for raw in sorted(TECH_TERMS, key=lambda t: -len(t))]
    return F.coalesce(*found)


def generic_software_title(x: Column) -> Column:
    return _contains_any(F.lower(x), GENERIC_TITLE_WORDS)


def inferred_title(x: Column) -> Column:
    """A role made from the technology that a text names, else null."""
    label = tech_label(x)
    role = F.when(label.isin(*INFRASTRUCTURE), F.concat(label, F.lit(" Engineer"))).otherwise(F.concat(label, F.lit(" Developer")))
    return F.when(F.contains(F.lower(x), F.lit("react native")), F.lit("React Native Developer")).otherwise(role)


def clean_title(x: Column) -> Column:
    """A posting's title without numbering, bonus notes and brackets; generic titles get a technology or a default."""
    out = x
    for pattern in (r"^\s*\d+(?:\s*[/_-]\s*\d+)+\s*", r"^\s*\d+\s*[.)]\s*", r"^\s*\d+\s+", r"(?i)\s*\+\s*(?:welcome\s+bonus|sign[- ]?on\s+bonus|bonus|equity).*$", r"\([^)]*\)"):
        out = F.regexp_replace(out, pattern, "")
    out = F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" -|/"))
    poor = (out == "") | F.lower(out).isin(*GENERIC_TITLES) | ~out.rlike(r"\p{L}")
    tech = tech_label(x)
    named = F.when(generic_software_title(out) & tech.isNotNull() & ~F.contains(F.lower(out), F.lower(tech)), F.concat(out, F.lit(" ("), tech, F.lit(")"))).otherwise(out)
    return F.substring(F.when(poor, F.coalesce(inferred_title(x), F.lit("Software Engineer"))).otherwise(named), 1, 80)


def looks_like_occupation(name: Column) -> Column:
    return _contains_any(F.lower(name), ROLE_WORDS)


def proficiency(context: Column) -> Column:
    """Level of the first rule whose word stands in a context, else null."""
    low = F.lower(context)
    return F.coalesce(*[F.when(F.contains(low, F.lit(word)), F.lit(level)) for word, level in PROFICIENCY_RULES])


def essential(context: Column) -> Column:
    """False if a context has an optional hint (also inside a longer word)."""
    return ~_contains_any(F.lower(context), OPTIONAL_HINTS)


def experience_years(context: Column) -> Column:
    """The first number of years that a context names, else null."""
    return F.nullif(F.regexp_extract(F.lower(context), YEARS, 1), F.lit("")).try_cast("double")


def context_window(text: Column, start: Column, end: Column, width: int = 30) -> Column:
    low = F.greatest(start - width, F.lit(0))
    return F.substring(text, low + 1, end + width - low)


def node_id(canonical_id: Column, kind: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(canonical_id, F.lit("")), F.concat(F.lit("local:"), kind, F.lit(":"), text))


def english_name(primary: Column, candidates: Column) -> Column:
    """The first of a name and its sorted alternatives that has an ASCII letter, else the name."""
    options = F.concat(F.array(primary), F.array_sort(candidates))
    return F.coalesce(F.get(F.filter(options, lambda x: x.rlike("[A-Za-z]")), F.lit(0)), primary)


def display_name(primary: Column, alt_names: Column) -> Column:
    """A name without mojibake, else the first readable one of the ``|`` list, else the name itself."""
    broken = f"[{MOJIBAKE}]"
    readable = F.get(F.filter(F.split(alt_names, r"\|"), lambda x: (F.trim(x) != "") & ~x.rlike(broken)), F.lit(0))
    return F.when(~primary.rlike(broken), primary).otherwise(F.coalesce(readable, primary))


def safe_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.cast("string").try_cast("double").cast("bigint"), F.lit(default))


def jaccard_distance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def relation_input(head: Column, tail: Column, text: Column) -> Column:
    return F.concat(F.lit("[E1] "), head, F.lit(" [/E1] [E2] "), tail, F.lit(" [/E2] "), text)
