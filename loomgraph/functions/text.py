"""Column builders for text: identity, size, trimming, stemming and noise tests.

All are plain expressions, so they stay inside generated code. White space is what JavaScript
calls white space; word boundaries are ASCII; lengths are in UTF-16 units where a limit is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as trimmed and split on.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Suffix rules of the stemmer, first match wins: suffix, least word length, letters cut, letters added.
STEM_RULES = (
    ("ies", 5, 3, "y"), ("sses", 4, 2, ""), ("ness", 4, 4, ""), ("ments", 5, 5, ""), ("ment", 5, 4, ""),
    ("ings", 6, 4, ""), ("ing", 6, 3, ""), ("tion", 6, 4, ""), ("ated", 4, 4, ""), ("ised", 4, 4, ""), ("ized", 4, 4, ""),
    ("ful", 4, 3, ""), ("ous", 4, 3, ""), ("ive", 4, 3, ""), ("able", 4, 4, ""), ("ible", 4, 4, ""), ("ally", 4, 4, ""),
    ("ily", 4, 3, ""), ("ly", 5, 2, ""), ("ed", 5, 2, ""), ("er", 5, 2, ""), ("es", 5, 2, ""),
)

#: Words that carry no meaning in a search.
STOP_WORDS = tuple(
    """
    the a an is are was were be been being have has had do does did will would could should may might shall can
    to of in for on with at by from as into about like through after over between out up down off
    and but or nor not so yet both either neither each every all any few more most other some such no only own same
    than too very just because if when where how what which who whom this that these those am
    its my we our your his her they them it he she you me him us
    also then now here there why well still even back much many way get got let say tell know think see want use try
    ask need feel take come make find give put thing things stuff something anything everything nothing someone anyone
    everyone nobody work works working worked going done look looks right sure okay yeah yes hey please thanks
    check show read help run open close set call send start stop keep move turn pull went goes able another again
    really actually basically probably maybe remember
    """.split()
)

#: Names too general to be entities.
NOISE_ENTITIES = (
    "doc", "docs", "spreadsheet", "file", "files", "link", "links", "meeting", "meetings", "call", "standup", "email", "emails",
    "message", "messages", "task", "tasks", "note", "notes", "update", "updates", "fix", "bug", "issue", "issues",
    "api", "key", "keys", "token", "tokens", "url", "config", "test", "tests", "code", "data", "repo", "branch",
    "folder", "directory", "script", "command", "tool", "error", "log", "logs", "output", "input", "response",
    "csv file", "json file", "text file",
)

_END = r"(?![A-Za-z0-9_])"  # an ASCII word boundary after a letter
#: Beginnings of texts that are chatter, commands or passing states. {names} are people the user names.
NOISE_TEXT = (
    rf"(?:go to|let'?s |ok{_END}|thanks|sure|will do|sounds good|i'?ll |yes{_END}|no{_END})",
    r"(?:join|check |look |try |see |run |open |send |start |stop |i'?m going)",
    rf"(?:sorry|please |hey |hi |good morning|good night|gm{_END}|gn{_END})",
    r"(?:i'll run|i'll use|i'll stop|i'll stay)",
    r"(?:schedule |add .+ to (?:the )?calendar|remove .+ from (?:the )?calendar)",
    r"(?:going to|headed to)",
    r"[A-Za-z0-9_]+ (?:is|was) (?:testing|fixing|finishing|working|doing|checking|looking|pushing|deploying)",
    r"[A-Za-z0-9_]+ [A-Za-z0-9_]+ (?:is|was) (?:testing|fixing|finishing|working|doing|checking|looking|pushing|deploying)",
    rf"need to (?:set up|configure|fix|check|look|update|deploy|push|test){_END}",
)
#: What people named by the user do that is passing.
NOISE_ACTS = r"(?:will execute|will focus|is going|confirmed|scheduled|deleted|added|moved|unpacked|sent|stored|documented|fixed)"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def utf16_left(text: Column, n: int) -> Column:
    """The first n UTF-16 units; a code point cut in half becomes a replacement character."""
    return F.when(F.length(text) * 2 <= n, text).otherwise(F.decode(F.substring(F.encode(text, "UTF-16LE"), 1, 2 * n), "UTF-16LE"))


def tokens_of_length(length: Column) -> Column:
    return F.ceil(length / 4).cast("long")


def estimate_tokens(text: Column) -> Column:
    return tokens_of_length(utf16_length(text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_id(kind: Column | str, name: Column) -> Column:
    """kind:name, the name lower-cased, other runs than a-z and 0-9 as one underscore, one underscore off either end."""
    prefix = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(prefix, F.lit(":"), F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), r"^_|_\z", ""))


def text_id(kind: Column | str, text: Column) -> Column:
    """The id of a fact, decision, preference or frustration: canonical over its first 60 units."""
    return canonical_id(kind, utf16_left(text, 60))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("document:"), F.substring(F.sha2(path, 256), 1, 12))


def stem(word: Column) -> Column:
    n = F.length(word)
    out = F.when(word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1)).otherwise(word)
    for suffix, least, cut, added in reversed(STEM_RULES):
        stemmed = F.left(word, n - cut)
        out = F.when(word.endswith(suffix) & (n >= least), F.concat(stemmed, F.lit(added)) if added else stemmed).otherwise(out)
    return F.when((n < 4) | (word == "ment"), word).otherwise(out)


def stem_word(word: str) -> str:
    """stem() of one word, for query terms on the driver."""
    if len(word) < 4 or word == "ment":
        return word
    for suffix, least, cut, added in STEM_RULES:
        if word.endswith(suffix) and len(word) >= least:
            return word[: len(word) - cut] + added
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def is_noise_entity(name: Column) -> Column:
    lower = F.lower(name)
    return name.isNull() | (name == "") | lower.isin(*NOISE_ENTITIES) | (utf16_length(lower) < 3) | lower.rlike(r"^[0-9]+\z")


def noise_pattern(names: tuple[str, ...] = ()) -> str:
    acts = [rf"(?:{'|'.join(names)}) {NOISE_ACTS}"] if names else []
    return "(?i)^(?:" + "|".join([*NOISE_TEXT, *acts]) + ")"


def is_noise_text(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Too short, too long, or chatter. names: lower-case first names (patterns) whose passing acts are noise too."""
    n = utf16_length(text)
    return text.isNull() | (n < 25) | (n > 200) | trim(text).rlike(noise_pattern(names))


def is_chat(content: Column) -> Column:
    """Three of the first twenty lines begin with a date and a time."""
    lines = F.slice(F.split(content, "\n", -1), 1, 20)
    return F.size(F.filter(lines, lambda x: x.rlike(CHAT_LINE))) >= 3


_DATE = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"
#: How a chat line begins; with a sender; and the parts of its time.
CHAT_LINE = rf"^\[?{_DATE},?{SPACE}+[0-9]{{1,2}}:[0-9]{{2}}"
CHAT_SENDER = rf"^\[?{_DATE},?{SPACE}+[0-9]{{1,2}}:[0-9]{{2}}[:0-9]*{SPACE}*(?:AM|PM)?\]?{SPACE}*[-–]?{SPACE}*([^:]+):"
CHAT_TIME = rf"^\[?([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{2,4}}),?{SPACE}+([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?{SPACE}*(AM|PM)?"


def chat_millis(line: Column) -> Column:
    """Milliseconds of a chat line's month-first time, null where it cannot be read (then no gap is seen)."""
    at = lambda i: F.regexp_extract(line, CHAT_TIME, i)
    number = lambda i: at(i).try_cast("int")
    year = F.when(number(3) < 50, number(3) + 2000).when(number(3) < 100, number(3) + 1900).otherwise(number(3))
    half = at(7)
    hour = F.when(half == "", number(4)).when(number(4) > 12, F.lit(None)).otherwise(number(4) % 12 + F.when(half == "PM", 12).otherwise(0))
    seconds = F.coalesce(number(6), F.lit(0))
    stamp = F.try_make_timestamp(year, number(1), number(2), hour, number(5), seconds)
    return F.when(at(1) != "", F.unix_millis(stamp))
