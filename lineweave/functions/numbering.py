"""Section numbers: what numbers a line may begin with, which follows which, and how far its body is indented."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals (the empty one counts as 0), bullets, alphabets.
ROMAN = "X{0,2}I[XV]|V?I{0,3}"
ROMAN_VALUES = {"": 0, "I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "XIV": 14, "XIX": 19, "XXIV": 24, "XXIX": 29}
BULLETS = "[・\\-*+•‣⁃○∙◦⦾⦿\ue000-\uf8ff]"
ARABIC = "[1-9][0-9]*"
MULTILEVEL = "[1-9][0-9]*(?:[.-][1-9][0-9]*)*[.-]({})".format(ARABIC)
HIRAGANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"
KATAKANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン"
HIRAGANA_IROHA = "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえてあさきゆめみしゑひもせすん"
KATAKANA_IROHA = "イロハニホヘトチリヌルヲワカヨタレソツネナラムウヰノオクヤマケフコエテアサキユメミシヱヒモセスン"
KANJI_DIGITS = {"一": 1, "壱": 1, "壹": 1, "二": 2, "弐": 2, "貳": 2, "三": 3, "参": 3, "參": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陸": 6, "七": 7, "漆": 7, "質": 7, "八": 8, "捌": 8, "九": 9, "玖": 9, "〇": 0, "十": 10, "拾": 10, "什": 10}
#: Runs of enclosed characters: (first code points and lengths of the runs that make one alphabet).
ENCLOSED = (((0x2460, 20), (0x3251, 15), (0x32B1, 15)), ((0x32D0, 46),), ((0x3280, 9),), ((0x24B6, 26),), ((0x24D0, 26),))

#: A number stands in brackets, before one of these, or after one of those; Japanese lines have chapters and articles too.
CLOSERS_EN, OPENERS_EN = r"(?:\. |\)|  |:)", "(?:§|ARTICLE *|Article *|SECTION *|Section *)"
SECTIONS_JA = " *[章節項条]"

CANDIDATES = "array<struct<kind:string,num:int,bullet:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of number: its regex, and how what it matches becomes an integer (SQL with {0} for the match)."""

    name: str
    regex: str
    value: str
    sections: bool = False


_LETTER = "ascii(lower({0})) - 96"
_INT = "try_cast({0} AS INT)"


def _lookup(table: dict[str, int], of: str) -> str:
    return f"map({', '.join(f"'{k}', {v}" for k, v in table.items())})[{of}]"


_ROMAN = _lookup(ROMAN_VALUES, "upper({0})")


def _kansuji() -> str:
    """One to three characters to 1..99; no number otherwise."""
    a, b, c = (_lookup(KANJI_DIGITS, f"substr({{0}}, {k}, 1)") for k in (1, 2, 3))
    two = f"CASE WHEN {a} = 10 AND {b} IN (0, 10) THEN NULL WHEN {a} = 10 THEN 10 + {b} WHEN {b} = 10 AND {a} = 0 THEN NULL WHEN {b} = 10 THEN 10 * {a} ELSE nullif(10 * {a} + {b}, 0) END"
    three = f"CASE WHEN {b} <> 10 OR {c} IN (0, 10) OR {a} IN (0, 10) THEN NULL ELSE 10 * {a} + {c} END"
    return f"CASE length({{0}}) WHEN 1 THEN nullif({a}, 0) WHEN 2 THEN {two} ELSE {three} END"


def _at(alphabet: str) -> str:
    return f"instr('{alphabet}', {{0}}) - 1"


EN = (
    Kind("arabic_multilevel", MULTILEVEL, _INT), Kind("alph_lower", "([a-z])", _LETTER), Kind("alph_upper", "([A-Z])", _LETTER),
    Kind("roman_lower", f"({ROMAN.lower()})", _ROMAN), Kind("roman_upper", f"({ROMAN})", _ROMAN), Kind("arabic", f"({ARABIC})", _INT),
)
JA = (
    Kind("kansuji", f"([{''.join(KANJI_DIGITS)}]{{1,3}})", _kansuji(), True),
    Kind("katakana_iroha", f"([{KATAKANA_IROHA}])", _at(KATAKANA_IROHA)), Kind("hiragana_iroha", f"([{HIRAGANA_IROHA}])", _at(HIRAGANA_IROHA)),
    Kind("katakana", f"([{KATAKANA}])", _at(KATAKANA)), Kind("hiragana", f"([{HIRAGANA}])", _at(HIRAGANA)),
    Kind("arabic_multilevel", MULTILEVEL, _INT, True), Kind("alph_lower", "([a-z])", _LETTER), Kind("alph_upper", "([A-Z])", _LETTER),
    Kind("roman_lower", f"({ROMAN.lower()})", _ROMAN, True), Kind("roman_upper", f"({ROMAN})", _ROMAN, True), Kind("arabic", f"({ARABIC})", _INT, True),
)


def forms(kind: Kind, language: str = "en") -> list[str]:
    """Regexes of the forms a kind may have; at most one of each list matches a text."""
    n = kind.regex
    if language == "en":
        return [rf"^\({n}\)", f"^{n}{CLOSERS_EN}", f"^{OPENERS_EN}{n}"]
    out = [rf"^\({n}\)", f"^{n}{CLOSERS_EN}", f"^§{n}", f"^【{n}】"]
    return out + ([f"^第? *{n}{SECTIONS_JA}"] if kind.sections else [])


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Few lines begin like this; the others have no number, and no other regex is tried on them.
MAYBE = {
    "en": rf"^(?:{BULLETS}|\([0-9A-Za-z.-]*\)|[0-9A-Za-z.-]*?(?:\. |\)|  |:)|§|ARTICLE|Article|SECTION|Section)",
    "ja": rf"^(?:{BULLETS}|\([^)]{{0,60}}\)|[^ ]{{0,60}}?(?:\. |\)|  |:)|§|【|第|[㉑-㏾①-⓿㈀-㋿]|[^ ]{{0,60}}? *[章節項条])",
}


#: Kinds that users have added, by language.
_ADDED: dict[str, list[Kind]] = {"en": [], "ja": []}


def register(kind: Kind, language: str = "en") -> None:
    """Let candidates() find another kind of number in every form that the language has. A name that is taken: ValueError.

    `kind.regex` has one group, the number; `kind.value` is SQL for its integer, with {0} for what the group matched.
    """
    if kind.name in {k.name for k in kinds(language)}:
        raise ValueError(f"there is a kind {kind.name!r}")
    _ADDED[language].append(kind)


def unregister(name: str, language: str = "en") -> None:
    _ADDED[language][:] = [k for k in _ADDED[language] if k.name != name]


def kinds(language: str = "en") -> tuple[Kind, ...]:
    """The language's own kinds, in their order, and those added to it."""
    return (*(EN if language == "en" else JA), *_ADDED[language])


def candidates(text: str, language: str = "en") -> Column:
    """All numbers that the line in column `text` may begin with, in the order of their kinds; a bullet is its own number.

    A null text has none.
    """
    t = f"trim({text})"
    none = "cast(NULL AS STRING)"
    made = [f"IF({t} RLIKE {_quoted('^' + BULLETS)}, named_struct('kind', 'bullet_point', 'num', cast(NULL AS INT), 'bullet', substr({t}, 1, 1)), NULL)"]
    if language == "ja":
        for runs in ENCLOSED:
            characters = "".join(chr(a + k) for a, n in runs for k in range(n))
            made.append(f"IF({t} RLIKE '^[{characters}]', named_struct('kind', 'kakoimoji', 'num', instr('{characters}', substr({t}, 1, 1)) - 1, 'bullet', {none}), NULL)")
    for kind in kinds(language):
        for form in forms(kind, language):
            value = kind.value.format(f"regexp_extract({t}, {_quoted(form)}, 1)")
            made.append(f"IF({t} RLIKE {_quoted(form)}, named_struct('kind', '{kind.name}', 'num', cast({value} AS INT), 'bullet', {none}), NULL)")
    sql = f"filter(array({', '.join(made)}), x -> x IS NOT NULL AND (x.num IS NOT NULL OR x.bullet IS NOT NULL))"
    maybe = "|".join(f"(?:{x})" for x in (MAYBE[language], *(form for kind in _ADDED[language] for form in forms(kind, language))))
    return F.expr(f"IF({t} RLIKE {_quoted(maybe)}, cast({sql} AS {CANDIDATES}), cast(array() AS {CANDIDATES}))")


def any_next(following: str, before: str) -> Column:
    """Whether some candidate of `following` comes right after some candidate of `before` (columns of candidates)."""
    return F.expr(f"exists({before}, a -> exists({following}, b -> a.kind = b.kind AND coalesce(a.bullet = b.bullet, a.num + 1 = b.num, false)))")


_ANY = f"(?:[a-zA-Z]|{ARABIC}|(?:{ROMAN.lower()})|(?:{ROMAN})|(?:[1-9][0-9]*(?:[.-][1-9][0-9]*)*[.-][1-9][0-9]*))"
_TEMPLATES = (r"\({}\)", r"{}\. ", r"{}\)", "{}  ", "§{}", "{}:", "ARTICLE *{}", "Article *{}", "SECTION *{}", "Section *{}")
#: Blanks, a number or bullet, blanks, at the start of a line; always matches.
BODY = f"^ *(?:{'|'.join(x.format(_ANY) for x in _TEMPLATES)}|{BULLETS})? *"


def body_indent(text: Column) -> Column:
    """Characters before a line's body."""
    return F.length(F.regexp_extract(text, BODY, 0))


# states of a numbered list (fixed values)
NO_NUM, CONSECUTIVE, DOWN, UP, UNKNOWN = range(5)


def follows(number: tuple, before: tuple) -> bool:
    kind, num, bullet = number
    return kind == before[0] and (bullet == before[2] if bullet is not None else before[1] is not None and num == before[1] + 1)


class NumberedList:
    """A stack of section numbers, each with a value of the caller's."""

    def __init__(self, stack: list | None = None) -> None:
        self.stack: list[tuple[tuple, int]] = stack or []

    def push(self, found: list[tuple], value: int = 0) -> tuple[int, int | None]:
        """(state, value of the level that is resumed or None) after a line with these candidates."""
        if not found:
            return NO_NUM, None
        for depth in range(len(self.stack) - 1, -1, -1):
            own = next((c for c in found if follows(c, self.stack[depth][0])), None)
            if own is not None:
                resumed, top = self.stack[depth][1], depth == len(self.stack) - 1
                self.stack[depth:] = [(own, value)]
                return (CONSECUTIVE if top else UP), resumed
        own = next((c for c in found if c[2] is not None or c[1] <= 1), None)
        if own is None:
            return UNKNOWN, None
        self.stack.append((own, value))
        return DOWN, None
