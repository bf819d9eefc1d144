"""Texts: cleaning, tokens, anchors, options and answers.

Patterns take whatever script a corpus is in; those for Chinese exam papers are the defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks questions, options, materials and noise in the papers read.
STOP_WORDS = ("资料分析题库", "资料分析", "夸夸刷", "单位", "以下", "哪个", "范围", "的是", "约为", "比重", "同比", "增长", "亿元", "万人", "资料", "分析", "题库", "image", "chart", "visuals")
TEACHING = r"(考法[一二三四五六七八九十\d]+|问法[一二三四五六七八九十\d]+|专项讲解|思路点拨|知识点|核心提示|方法技巧|易错点)"
ANCHOR = r"^\s*(?:(?:【\s*)?例\s*\d+\s*】?|第\s*\d+\s*题|\d{1,3}(?:[．、]|[.](?!\d))|[（(]\d{1,3}[）)])"
VISUAL_NEEDED = r"(根据.*?(资料|图|表)|上图|上表|下图|下表|图中|表中)"
PLACEHOLDER = r"\[(?:image|chart|table|visual)[^\]]*\]|!\[[^\]]*\]\([^)]*\)"
OPTION = r"([A-D])\s*[.．、]\s*([^A-D\n]*)"
ANSWER_KEY = r"(\d{1,3})\s*[.．、]\s*([A-D]|对|错)"
JUDGE = {"正确": "对", "√": "对", "错误": "错", "×": "错"}
CJK = r"[\x{4e00}-\x{9fa5}]"


def lines(text: Column, cut: str = "\n") -> Column:
    return F.split(text, cut)


def truncated(text: Column, most: int = 100) -> Column:
    """At most so many characters, with dots if cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def prefix(text: Column, most: int = 60) -> Column:
    return F.substring(text, 1, most)


def answer(text: Column) -> Column:
    """Answers are compared trimmed and in upper case; null is blank."""
    return F.upper(F.trim(F.coalesce(text, F.lit(""))))


def solver_answer(text: Column) -> Column:
    """As answer(), with full-width and trailing points gone."""
    return F.regexp_replace(F.translate(answer(text), "．。", ".."), r"[.、]+$", "")


def signature(text: Column, most: int = 500) -> Column:
    """Without white space, then without punctuation, cut, in lower case: in that order."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x{a0}]+", "")
    return F.lower(F.substring(F.regexp_replace(bare, r"\p{P}", ""), 1, most))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def normalised(text: Column) -> Column:
    """Line ends, tabs, wide spaces and runs of empty lines made plain."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[\t 　]", " ")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def without_placeholders(text: Column, pattern: str = PLACEHOLDER) -> Column:
    """Placeholders go, and lines of which nothing is left."""
    own = F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: F.trim(F.regexp_replace(x, pattern, "")))
    return F.trim(F.array_join(F.filter(own, lambda x: x != ""), "\n"))


def without_orphan_brackets(text: Column) -> Column:
    """Lines that are one corner bracket go, and such at the wrong end of the text."""
    own = F.filter(lines(text), lambda x: ~F.trim(x).isin("【", "】"))
    out = F.trim(F.array_join(own, "\n"))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"^\s*】+", "")), r"【+\s*$", ""))


def cleaned(text: Column) -> Column:
    return without_orphan_brackets(without_placeholders(text))


def without_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~F.rlike(x, F.lit(pattern))), "\n")


def cut_at(text: Column, pattern: str) -> Column:
    """What comes before a pattern's first match."""
    return F.trim(F.split(text, pattern, 2)[0])


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(text, F.lit(w)), F.lit(False)) for w in words])


def replaced(text: Column, words: list[str], by: str = "") -> Column:
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(by)), words, text)


def like(text: Column, keyword: str) -> Column:
    """Anywhere in the text; _ and % are wildcards, as users may type them."""
    return text.like(f"%{keyword}%")


def search(keyword: str, *columns: Column) -> Column:
    """Any column has the keyword, whatever the case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(keyword.lower())), F.lit(False)) for c in columns])


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct words of so many characters at least."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\W+"), lambda w: F.length(w) >= least))


def significant_tokens(text: Column) -> Column:
    """Distinct words that say what a text is about: Latin runs of two and more, Chinese runs
    and their pairs of characters, without option labels, images and stop words.  Pairs are
    made only of texts that have longer Chinese runs."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)[A-D]\s*[.、．]", " "), r"!\[[^\]]*\]\([^)]+\)", " ")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    runs = F.array_except(F.regexp_extract_all(F.lower(bare), F.lit(rf"({CJK}{{2,}}|[a-z0-9]{{2,}})")), stop)

    def pairs(w: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
        chinese = F.rlike(w, F.lit(rf"^{CJK}+$")) & (F.length(w) > 2)
        return F.when(chinese, F.concat(F.array(w), own)).otherwise(F.array(w))

    return F.when(F.rlike(text, F.lit(f"{CJK}{{3}}")), F.array_except(F.flatten(F.transform(runs, pairs)), stop)).otherwise(runs)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def role_of(line: Column, rules: list[tuple[str, str]], otherwise: str = "text") -> Column:
    """The name of the first rule whose pattern a line matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(line, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def anchor_index(line: Column) -> Column:
    """The number in a question's anchor, whichever of its four forms it has."""
    forms = (r"^\s*【?\s*例\s*(\d+)", r"^\s*第\s*(\d+)\s*题", r"^\s*(\d{1,3})(?:[．、]|[.](?!\d))", r"^\s*[（(](\d{1,3})[）)]")
    return F.coalesce(*[F.regexp_extract(line, f, 1).try_cast("int") for f in forms])


def option_map(text: Column, pattern: str = OPTION) -> Column:
    """Options in a text; of a label's repeats the first counts."""
    from gradeloom.functions.arrays import first_wins

    labels, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(labels, values, lambda k, v: F.struct(k.alias("key"), F.trim(v).alias("value")))
    return first_wins(pairs)


def answer_key(text: Column, first: bool = True, pattern: str = ANSWER_KEY) -> Column:
    """Question number to answer; of repeats the first or the last counts."""
    from gradeloom.functions.arrays import first_wins, last_wins

    numbers, answers = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(numbers, answers, lambda k, v: F.struct(k.cast("int").alias("key"), v.alias("value")))
    return (first_wins if first else last_wins)(pairs)


#: The forms in which an answer is stated, the first that is found counts.
STATED = (
    r"(?i)【\s*答案\s*】\s*[:：]?\s*([A-D]|对|错|正确|错误)",
    r"(?i)答案\s*[:：]?\s*([A-D]|对|错|正确|错误)",
    r"(?i)选\s*([A-D])",
    r"(?iU)(?:【\s*例\s*\d{1,4}\s*】|例\s*\d{1,4}\s*[：:]?)\s*([A-D]|对|错|正确|错误)\b",
    r"(?im)^\s*\d{1,4}\s*[.、．]\s*([A-D])\b",
)
#: The forms in which an analysis is given.
ANALYSIS = (r"(?s)【\s*解析\s*】\s*[:：]?(.*)", r"(?s)解析\s*[:：](.*)", r"(?si)答案\s*[:：]?.*?[A-D对错正确错误][。\s]*(.*)")
#: Anchors of answers; group 1 is the number.
ANCHORS = (r"【\s*例\s*(\d{1,4})\s*】", r"例\s*(\d{1,4})\s*[：:]", r"第\s*(\d{1,4})\s*题", r"^\s*(\d{1,4})\s*[.、．]")


def stated_answer(text: Column) -> Column:
    """The answer that a text states; right and wrong in one spelling."""
    found = F.upper(F.coalesce(*[F.nullif(F.regexp_extract(text, f, 1), F.lit("")) for f in STATED]))
    return reduce(lambda c, kv: F.when(found == kv[0], F.lit(kv[1])).otherwise(c), JUDGE.items(), found)


def stated_analysis(text: Column) -> Column:
    """The analysis that a text gives, without what leads to it; null if it gives none."""
    forms = [F.when(F.rlike(text, F.lit(f)), F.regexp_extract(text, f, 1)) for f in ANALYSIS]
    own = F.regexp_replace(F.trim(F.coalesce(*forms)), r"^\s*[。；;，,：:]\s*", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def anchors_in(text: Column) -> Column:
    """Anchors in a text, in order: start, index and label; where two forms start at one place
    the first form's counts."""
    from gradeloom.functions.marks import places

    own = lambda m, hit: F.struct(m["start"].alias("start"), hit["index"].alias("index"), F.trim(hit["label"]).alias("label"))
    return F.transform(places(text, ANCHORS), lambda m: own(m, m["hits"][0]))


def cut_at_anchors(text: Column) -> Column:
    """A text's parts from each anchor to the next, as structs of index, label and block, the
    white space around it gone; what stands before the first anchor is no part."""

    from gradeloom.functions.marks import root

    def parts(own: Column) -> Column:
        n, width = F.size(own), root(F.size(own))
        end = lambda i: F.coalesce(F.get(own, i + 1)["start"], F.length(text))

        def run(k: Column) -> Column:
            # characters are counted from a text's beginning: a run of parts is cut out first, and then cut up
            at = F.get(own, k * width)["start"]
            whole = F.substring(text, at + 1, end(F.least(n, (k + 1) * width) - 1) - at)
            block = lambda c, m, i: F.regexp_replace(F.substring(c, m["start"] - at + 1, end(k * width + i) - m["start"]), r"(?U)^\s+|\s+$", "")
            return let(whole, lambda c: F.transform(F.slice(own, k * width + 1, width), lambda m, i: F.struct(m["index"].alias("index"), m["label"].alias("label"), block(c, m, i).alias("block"))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / width).cast("int")), run))

    return let(anchors_in(text), parts)


def logical_lines(text: Column) -> Column:
    """A text cut before each anchor and option; blank pieces go."""
    parts = F.split(F.trim(text), r"(?=(?:(?:【\s*)?例\s*\d+\s*】?|第\s*\d+\s*题|[A-D][.．、]))")
    own = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(own)


def split_options(text: Column, pattern: str = r"^\s*([A-D])\s*[.．、]\s*(.*)$") -> Column:
    """A block's stem, and its option lines by label; of a label's repeats the last counts."""
    from gradeloom.functions.arrays import last_wins

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern))), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.trim(F.regexp_extract(x, pattern, 2)).alias("value")))
    stem = F.array_join(F.filter(lines, lambda x: ~F.rlike(x, F.lit(pattern))), "\n")
    return F.struct(stem.alias("stem"), last_wins(pairs).alias("options"))


#: Lines that name a chapter.
CHAPTER_LINES = (r"^\s*第[一二三四五六七八九十百千万\d]+章\s*\S*", r"^\s*[一二三四五六七八九十]+[、.]\s*\S+", r"^\s*\d{1,2}[．.]\s*\S+", r"^\s*考法[一二三四五六七八九十\d]+\s*\S*")


def chapter_level(line: Column) -> Column:
    """Which of the forms of a chapter's name (from 0) a line has; null for lines above 60
    characters and those that begin a question."""
    from gradeloom.functions.marks import FORMS

    asks = reduce(lambda a, b: a | b, [F.rlike(line, F.lit(rf"(?U){f}")) for f in FORMS[:5]]) & (F.length(line) > 8)
    level = F.coalesce(*[F.when(F.rlike(line, F.lit(rf"(?U){f}")), F.lit(k)) for k, f in enumerate(CHAPTER_LINES)])
    return F.when((F.length(line) <= 60) & ~asks, level)


def stem_on_one_line(text: Column) -> Column:
    """A stem without lines that name a chapter, its white space single spaces."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.rlike(x, F.lit("|".join(CHAPTER_LINES))))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\s+", " "))


def hash_of_letters(text: Column) -> Column:
    """A number from 2 to 5 that a text always has."""
    return F.lit(2) + letters_sum(text) % 4


def fenced_json(text: Column) -> Column:
    """What a fenced code block holds, or the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), F.trim(text))


def file_name(url: Column) -> Column:
    """A url's last path part, percent-decoded."""
    return F.url_decode(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^\w.-]+", "_"), r"^_+|_+$", "")


def letters_sum(text: Column) -> Column:
    """Sum of a text's code points."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda a, b: a + b)


def punctuation_share(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\p{P}", "")
    return F.when(F.length(text) > 0, (F.length(text) - F.length(bare)) / F.length(text)).otherwise(F.lit(0.0))
