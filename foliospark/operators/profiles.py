"""Model profiles: how a response becomes text, and how an image is sized for a model.

Which response belongs to which profile is a column, so responses of many
models go through one plan.  Prompt texts that a model may echo are parameters
where they are long; short ones are given here.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.dialect import let
from ..functions.text import markup_to_text, split_front_matter, strip_chat_scaffold, strip_outer_fence, strip_output_tag, strip_trailing_tokens

END_TOKENS = ("<|assistant|>", "<|endoftext|>", "<|im_end|>", "<|system|>", "<|user|>")


@dataclass(frozen=True)
class Profile:
    """Steps in this order: end tokens (unbounded), scaffold, end tokens (8 at most), fence, front matter, output tag, plain text.

    keep: the name under which the markup is kept in the metadata when the
    text is made plain.  size: fit (longest side), grid, budget or none.
    """

    prompts: tuple[str, ...] = ()
    scaffold: bool = False
    first_tokens: tuple[str, ...] = ()
    end_tokens: tuple[str, ...] = ()
    fence: bool = False
    front_matter: bool = False
    output_tag: bool = False
    keep: str | None = None
    size: str = "fit"
    longest: int = G.LONGEST
    max_tokens: int | None = None
    models: tuple[str, ...] = field(default=())


_ASSISTANT = "You are a helpful assistant."
_MARKDOWN = Profile(scaffold=True, end_tokens=END_TOKENS, fence=True, keep="raw_markdown")
DEFAULT = "default"
PROFILES: dict[str, Profile] = {
    DEFAULT: Profile(output_tag=True, max_tokens=25_000),
    "xml": Profile(max_tokens=25_000),
    "chandra": Profile(keep="raw_html", size="grid", max_tokens=12_384, models=("datalab-to/chandra-ocr-2",)),
    "deepseek": Profile(prompts=("<image>\nFree OCR.", "Free OCR."), scaffold=True, first_tokens=("<｜end▁of▁sentence｜>",), max_tokens=8_192, models=("deepseek-ai/DeepSeek-OCR-2",)),
    "firered": replace(_MARKDOWN, max_tokens=4_096, models=("FireRedTeam/FireRed-OCR",)),
    "nanonets": replace(_MARKDOWN, prompts=(_ASSISTANT,), max_tokens=15_000, models=("nanonets/Nanonets-OCR2-3B",)),
    "qianfan": replace(_MARKDOWN, prompts=("Parse this document to Markdown.",), size="none", max_tokens=4_096, models=("baidu/Qianfan-OCR",)),
    "glm": Profile(prompts=("Text Recognition:",), scaffold=True, end_tokens=tuple(t for t in END_TOKENS if t != "<|im_end|>"), size="budget", max_tokens=8_192, models=("zai-org/GLM-OCR",)),
    "dots-1.5": Profile(max_tokens=2_048, models=("kristaller486/dots.ocr-1.5",)),
    "dots-mocr": Profile(max_tokens=25_000, models=("rednote-hilab/dots.mocr",)),
    "paddle": Profile(prompts=("OCR:",), scaffold=True, max_tokens=4_096, models=("PaddlePaddle/PaddleOCR-VL-1.5",)),
    "infinity": Profile(prompts=(_ASSISTANT,), scaffold=True, fence=True, keep="raw_markdown", size="none", max_tokens=8_192, models=("infly/Infinity-Parser-7B",)),
    "mineru": Profile(size="none", models=("opendatalab/MinerU2.5-2509-1.2B",)),
    "olmocr": Profile(front_matter=True, keep="raw_markdown", longest=1_288, max_tokens=8_000, models=("allenai/olmOCR-2-7B-1025", "allenai/olmOCR-2-7B-1025-FP8")),
    "lfm": Profile(prompts=("Transcribe all visible text from this historical document page in reading order.",), scaffold=True, output_tag=True, max_tokens=25_000, models=("LiquidAI/LFM2.5-VL-1.6B",)),
}
_BY_MODEL = {m: name for name, p in PROFILES.items() for m in p.models}


def resolve(profile: Profile | str | None = None, model: str | None = None) -> Profile:
    """The profile itself, else by name (an unknown one is an error), else by model, else the default."""
    if isinstance(profile, Profile):
        return profile
    if profile is not None:
        name = _BY_MODEL.get(profile, profile)
        if name not in PROFILES:
            raise ValueError(f"unknown profile {profile!r}; there are {', '.join(sorted(PROFILES))}")
        return PROFILES[name]
    return PROFILES[_BY_MODEL.get(model or "", DEFAULT)]


def _cleaned(text: Column, p: Profile) -> Column:
    """Before plain text is made: the markup that a profile keeps, or the final text of one that keeps none."""
    if p.first_tokens:
        text = strip_trailing_tokens(F.regexp_replace(text, r"(?U)\s+\z", ""), p.first_tokens, None)
    if p.scaffold:
        text = strip_chat_scaffold(text, p.prompts)
    if p.end_tokens:
        text = strip_trailing_tokens(text, p.end_tokens)
    if p.fence:
        text = strip_outer_fence(text)
    if p.front_matter:
        text = split_front_matter(text)[1]
    if p.keep == "raw_html":
        text = F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")
    return strip_output_tag(text) if p.output_tag else text


def postprocess(text: Column, profile: Profile | str | None = None) -> Column:
    """struct (text, metadata map<string,string>) of responses of one profile."""
    p = resolve(profile)
    empty = F.create_map().cast("map<string,string>")
    if not p.keep:
        return F.struct(_cleaned(text, p).alias("text"), empty.alias("metadata"))
    raw = _cleaned(text, p)
    metadata = F.create_map(F.lit(p.keep), raw)
    if p.front_matter:
        metadata = F.map_concat(metadata, F.create_map(F.lit("front_matter"), F.to_json(split_front_matter(text)[0])))
    return F.struct(markup_to_text(raw).alias("text"), metadata.alias("metadata"))


def postprocess_by(text: Column, profile: Column, names: tuple[str, ...] = tuple(PROFILES)) -> Column:
    """struct (text, metadata) by a column of profile names; unknown names have the default profile.

    The markup is taken out once, whatever the number of profiles: only the
    steps before differ by row.
    """
    cleaned, keep = _cleaned(text, PROFILES[DEFAULT]), F.lit(None).cast("string")
    for name in names:
        if name != DEFAULT:
            p = PROFILES[name]
            cleaned = F.when(profile == name, _cleaned(text, p)).otherwise(cleaned)
            if p.keep:
                keep = F.when(profile == name, p.keep).otherwise(keep)
    keeps = any(PROFILES[n].keep for n in names)
    plain = markup_to_text(F.when(keep.isNotNull(), cleaned)) if keeps else F.lit(None).cast("string")
    fronted = [n for n in names if PROFILES[n].front_matter]
    front = F.when(profile.isin(*fronted), F.to_json(split_front_matter(text)[0])) if fronted else F.lit(None).cast("string")

    def pack(s: Column) -> Column:
        kept = F.when(s["keep"].isNotNull(), F.map_from_arrays(F.array(s["keep"]), F.array(s["raw"]))).otherwise(F.create_map().cast("map<string,string>"))
        kept = F.when(s["front"].isNotNull(), F.map_concat(kept, F.create_map(F.lit("front_matter"), s["front"]))).otherwise(kept)
        return F.struct(F.coalesce(s["plain"], s["raw"]).alias("text"), kept.alias("metadata"))

    return let(F.struct(cleaned.alias("raw"), plain.alias("plain"), keep.alias("keep"), front.alias("front")), pack)


def build_result(text: Column, provider: Column, model: Column, metadata: Column, extra: Column) -> Column:
    """struct (text, provider_name, model_name, metadata): entries of extra replace those of metadata."""
    return F.struct(text.alias("text"), provider.alias("provider_name"), model.alias("model_name"), merge_metadata(metadata, extra).alias("metadata"))


def merge_metadata(*maps: Column) -> Column:
    """One map of strings; a later entry replaces an earlier one, a null map has none."""
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps]))
    return let(entries, lambda es: F.map_from_entries(F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es) + 1), lambda x: x["key"] == e["key"]))))


def page_metadata(page: Column, caller: Column, page_index: Column, source_index: Column) -> Column:
    """The page's metadata with the caller's over it, and the indexes where neither has them."""
    own = F.create_map(F.lit("page_index"), page_index.cast("string"), F.lit("source_index"), source_index.cast("string"))
    return merge_metadata(own, page, caller)


def image_size(width: Column, height: Column, profile: Profile | str | None = None) -> Column:
    """The size in which an image goes to the model."""
    p = resolve(profile)
    if p.size == "grid":
        return G.grid_size(width, height)
    if p.size == "budget":
        return G.budget_size(width, height)
    return G.size(width, height) if p.size == "none" else G.fit_size(width, height, p.longest)


def conversation(prompt: str | None, image: Column, system: str | None = None, prompt_first: bool = False) -> Column:
    """Messages for a model: a system text, then the user's image and text (or text and image)."""
    part = lambda kind, text, data: F.struct(F.lit(kind).alias("type"), F.lit(text).cast("string").alias("text"), data.cast("binary").alias("image"))
    none = F.lit(None).cast("binary")
    content = [part("image", None, image)]
    if prompt:
        content.insert(0 if prompt_first else 1, part("text", prompt, none))
    user = F.struct(F.lit("user").alias("role"), F.array(*content).alias("content"))
    if system is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), F.array(part("text", system, none)).alias("content")), user)
