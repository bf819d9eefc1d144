"""Arrays of image structs (url, base64, ref, role, image_role, slot, caption, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a normalised image.
IMAGE = "struct<url:string,base64:string,ref:string,role:string,image_role:string,slot:string,caption:string,image_order:int,insert_position:string,belongs_to_question:boolean,linked_question_id:string,moved_from_question_id:string,same_visual_group_id:string>"
#: Which words name which slot of a question.
SLOTS = {
    "analysis": ["analysis", "explanation", "解析"],
    "options": ["options", "option", "choice", "选项"],
    "material": ["material", "passage", "材料"],
    "stem": ["stem", "question", "content", "题干"],
}
#: Roles of a parsed image that are a question's visual.
VISUAL_ROLES = ["chart", "table", "image", "visual", "question_visual"]


def image(**fields: Column) -> Column:
    """An image with these fields, the others null."""
    names = [f.split(":")[0] for f in IMAGE[len("struct<") : -1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(IMAGE)


def _text(c: Column) -> Column:
    """A text, null where it is blank to the platform: missing or empty."""
    return F.nullif(c, F.lit(""))


def images_of(a: Column) -> Column:
    """An array of images without those that have neither a url nor data; null is empty."""
    own = F.filter(a, lambda i: _text(i["url"]).isNotNull() | _text(i["base64"]).isNotNull())
    return F.coalesce(own, F.array().cast(f"array<{IMAGE}>"))


def from_urls(urls: Column) -> Column:
    """Images that are given by their urls alone."""
    return F.transform(urls, lambda u: F.from_json(F.to_json(F.struct(u.alias("url"))), IMAGE))


def role_of(role: Column) -> Column:
    """What part an image that a parser found plays."""
    r = F.coalesce(role, F.lit(""))
    return F.when(r == "material", F.lit("material")).when(F.startswith(r, F.lit("option_")), F.lit("option_image")).when(r.isin(VISUAL_ROLES), F.lit("question_visual")).otherwise(F.lit("unknown"))


def parsed(a: Column) -> Column:
    """Images as a parser found them: roles, places and positions filled in."""
    return F.transform(a, lambda i, k: i.withField("image_role", F.coalesce(_text(i["image_role"]), role_of(i["role"]))).withField("image_order", F.coalesce(i["image_order"], (k + 1).cast("int"))).withField("insert_position", F.coalesce(_text(i["insert_position"]), F.lit("below_stem"))))


def ordered(a: Column) -> Column:
    """Images numbered from 1 as they stand, each role standing in for the other."""

    def one(i: Column, k: Column) -> Column:
        role, own = _text(i["role"]), _text(i["image_role"])
        i = i.withField("image_role", F.coalesce(own, role, F.lit("unknown"))).withField("role", F.coalesce(role, own, F.lit("unknown")))
        return i.withField("insert_position", F.coalesce(_text(i["insert_position"]), F.lit("below_stem"))).withField("image_order", (k + 1).cast("int"))

    return F.transform(a, one)


def linked(a: Column, question: Column) -> Column:
    """Images that belong to a question but don't say which say that it is this one."""
    missing = lambda i: F.coalesce(i["belongs_to_question"], F.lit(False)) & _text(i["linked_question_id"]).isNull()
    return F.transform(a, lambda i: i.withField("linked_question_id", F.when(missing(i), question.cast("string")).otherwise(i["linked_question_id"])))


def slot_of(image: Column, otherwise: str = "stem") -> Column:
    word = F.lower(F.coalesce(_text(image["slot"]), image["role"], F.lit("")))
    out = F.lit(otherwise)
    for slot, words in reversed(SLOTS.items()):
        out = F.when(word.isin(words), F.lit(slot)).otherwise(out)
    return out


def in_slot(a: Column, slot: str, otherwise: str = "stem") -> Column:
    """The images of one slot of a question."""
    return F.filter(images_of(a), lambda i: slot_of(i, otherwise) == slot)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), 0)


def key_of(image: Column) -> Column:
    return F.coalesce(_text(image["url"]), _text(image["ref"]), _text(image["base64"]))


def distinct_refs(a: Column) -> Column:
    """Images, each ref at its first place; those without a ref all stay."""
    refs = F.transform(a, lambda i: F.coalesce(i["ref"], F.lit("")))
    return F.filter(a, lambda i, k: (F.coalesce(i["ref"], F.lit("")) == "") | (F.array_position(refs, F.coalesce(i["ref"], F.lit(""))) == k + 1))


def place_of(a: Column, key: Column) -> Column:
    """Where, from 0, the first image with a key stands; null if none has it."""
    return F.nullif(F.array_position(F.transform(a, key_of), key), F.lit(0)) - 1


def added(a: Column, image: Column) -> Column:
    return ordered(F.array_append(images_of(a), image))


def _placed(a: Column, key: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the images of an array and of the place of that with a key."""
    return _named(images_of(a), lambda own: _named(place_of(own, key), lambda at: use(own, at)))


def removed(a: Column, key: Column) -> Column:
    """Without the first image that has a key."""
    return _placed(a, key, lambda own, at: ordered(F.filter(own, lambda _, k: F.coalesce(k != at, F.lit(True)))))


def moved(a: Column, target: Column, key: Column, question: Column) -> tuple[Column, Column]:
    """The images of a question and of the one that its image with a key moves to."""
    going = _placed(a, key, lambda own, at: F.get(own, at.cast("int")))

    def arrived(image: Column) -> Column:
        own = images_of(target)
        return ordered(F.when(image.isNotNull(), F.array_append(own, image.withField("moved_from_question_id", question.cast("string")))).otherwise(own))

    return removed(a, key), _named(going, arrived)


def grouped(a: Column, key: Column, group: Column) -> Column:
    """An image and the one after it become one visual: the first's group, the second's, or a new one."""

    def joined(own: Column, at: Column) -> Column:
        of = lambda k: _text(F.get(own, k.cast("int"))["same_visual_group_id"])
        one = lambda name: F.transform(own, lambda i, k: F.when(k.between(at, at + 1) & (at + 1 < F.size(own)), i.withField("same_visual_group_id", name)).otherwise(i))
        return ordered(_named(F.coalesce(of(at), of(at + 1), group), one))

    return _placed(a, key, joined)
