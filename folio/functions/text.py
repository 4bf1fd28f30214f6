"""Document parsing as Column expressions: everything stays in the JVM, no Python function sees a row."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers and scripts understand it: ASCII, no-break space, BOM and the Unicode spaces.
WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: The same, one by one.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Platform names in the order in which they are tried.
PLATFORMS = (
    "NES", "SNES", "N64", "GameCube", "Wii", "Switch", "Genesis", "Saturn", "Dreamcast", "PS1", "PS2", "PS3", "PS4", "PS5",
    "PSP", "Vita", "Xbox", "Xbox 360", "Xbox One", "Game Boy", "GBA", "DS", "3DS", "PC", "Steam",
)
# Directory names (letters and digits, lower case) and the platforms they stand for.
PLATFORM_DIRS = {
    "nes": "NES", "snes": "SNES", "n64": "N64", "gamecube": "GameCube", "wii": "Wii", "switch": "Switch",
    "genesis": "Genesis", "saturn": "Saturn", "dreamcast": "Dreamcast", "ps1": "PS1", "ps2": "PS2", "ps3": "PS3",
    "ps4": "PS4", "ps5": "PS5", "psp": "PSP", "vita": "Vita", "xbox": "Xbox", "xbox360": "Xbox 360",
    "xboxone": "Xbox One", "gameboy": "Game Boy", "gba": "GBA", "gbc": "GBC", "ds": "DS", "3ds": "3DS", "pc": "PC",
    "sms": "SMS", "x1": "X1", "3rd": "3DO",
}
# Words that stay in lower case inside a title; path parts that end a name.
SMALL_WORDS = ("of", "the", "and", "a", "an", "in", "on", "at", "to", "for")
SECTION_WORDS = ("faqs", "guides", "walkthrough", "walkthroughs", "maps", "cheats")
# Tags by substring of the file name, then by pattern of the lower-cased content, in this order.
FILENAME_TAGS = (("faq", "FAQ"), ("walkthrough", "Walkthrough"), ("guide", "Guide"), ("maps", "Maps"), ("cheats", "Cheats"))
CONTENT_TAGS = (
    ("walkthrough", "Walkthrough"), ("achievement", "Achievements"), ("trophy", "Trophies"), ("secret", "Secrets"),
    ("boss", "Boss Guide"), ("character", "Characters"), ("item list|items:", "Items"), ("weapon", "Weapons"),
    ("collectible", "Collectibles"), ("unlock", "Unlockables"), ("rpg|role.playing", "RPG"), ("fps|first.person.shooter", "FPS"),
    ("platformer|platform game", "Platformer"), ("fighting game|fighter", "Fighting"), ("racing", "Racing"), ("puzzle", "Puzzle"),
    ("strategy|rts|turn.based", "Strategy"), ("adventure", "Adventure"), ("action", "Action"), ("simulation|sim", "Simulation"),
    ("sports", "Sports"), ("100%|complete", "Complete Guide"), ("beginner", "Beginner Friendly"), ("advanced|expert", "Advanced"),
    ("speedrun", "Speedrun"), ("ascii art", "ASCII Art"), ("table of contents|toc", "Table of Contents"),
)
# Entities in the order of replacement.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
# What stands for content that cannot be shown, and media types.
EMPTY_CONTENT = "[This guide appears to be empty or contains no readable content]"
PDF_CONTENT = "[PDF content - PDF parsing not yet implemented]\n\nFilename: "
MIME = {"txt": "text/plain", "html": "text/html", "md": "text/markdown", "pdf": "application/pdf"}
PREFIX, PLATFORM_PREFIX, ART_LINES = 8000, 1000, 100


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def group(c: Column, pattern: str, i: int = 1) -> Column:
    """Group i of the first match, null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i))


def blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+\z", "")


def detect_format(path: Column) -> Column:
    ext = F.element_at(F.split(F.lower(path), "[.]"), -1)
    return F.when(ext.isin("html", "htm"), "html").when(ext.isin("md", "markdown"), "md").when(ext == "pdf", "pdf").otherwise("txt")


def _upper_first(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))


def title_from_filename(path: Column) -> Column:
    name = F.regexp_replace(stem(path), r"^\d+-", "")
    name = F.regexp_replace(name, r"(?i)-(faqs?|guides?|walkthroughs?|maps?|cheats?)-?\d*\z", "")
    words = F.split(js_trim(F.regexp_replace(F.regexp_replace(name, "[_-]", " "), f"{WS}+", " ")), " ")

    def cased(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(*SMALL_WORDS) & (i > 0), low).otherwise(_upper_first(low))

    return F.array_join(F.transform(words, cased), " ")


def clean_title(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?i){WS}+v?\d+\.\d+(\.\d+)?{WS}*\z", "")
    c = F.regexp_replace(c, rf"(?i){WS}+by{WS}+.+\z", "")
    return js_trim(F.regexp_replace(F.regexp_replace(c, "[*_=-]{3,}", ""), f"{WS}+", " "))


def title_from_content(content: Column) -> Column:
    """Null if no line serves. A candidate's indent is read at its number among the non-blank lines, but in the full text."""
    bar = r"^[=\-*_#]+\z"

    def choose(raw: Column) -> Column:
        lines = F.transform(F.slice(F.filter(raw, lambda x: x.rlike(NOT_WS)), 1, 30), js_trim)  # no more are looked at

        def pick(rows: Column) -> Column:
            numbered = F.transform(F.slice(rows, 1, 30), lambda x, i: F.struct(x.alias("x"), F.length(F.regexp_extract(F.get(raw, i), f"^{WS}*", 0)).alias("indent")))

            def titled(s: Column) -> Column:
                x, n = s["x"], F.length(s["x"])
                fit = (n <= 120) & (n >= 3) & ~x.rlike(bar) & ~x.startswith("http")
                return fit & (x.rlike("(?i)guide|walkthrough|faq") | ((s["indent"] > 10) & (n < 80) & (n > 5)))

            def plain(x: Column) -> Column:
                return (F.length(x) >= 10) & (F.length(x) < 100) & ~x.startswith("http") & ~x.rlike(bar)

            return F.coalesce(F.get(F.filter(numbered, titled), F.lit(0))["x"], F.get(F.filter(F.slice(rows, 1, 10), plain), F.lit(0)))

        return let(lines, pick)

    return clean_title(let(F.split(content, "\n", -1), choose))


def decode_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def html_to_text(html: Column) -> Column:
    steps = (
        (r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"),
        (r"(?i)</div>", "\n"), (r"(?i)</h[1-6]>", "\n"), (r"<[^>]+>", ""),
    )
    text = decode_entities(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, html))
    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n", -1), js_trim), "\n"), r"\n{3,}", "\n\n")


def html_title(html: Column) -> Column:
    return F.coalesce(*[js_trim(group(html, rf"(?i)<{tag}[^>]*>([^<]+)</{tag}>")) for tag in ("title", "h1")])


def markdown_title(text: Column) -> Column:
    return js_trim(group(text, r"(?m)^#\s+(.+)$"))


def stated_author(content: Column, space: str = r"\s") -> Column:
    """The rest of the line after `by` (`written by` and `created by` end so) or `author`, as it stands. space: what may follow
    them, as inside brackets."""
    return group(F.substring(content, 1, PREFIX), rf"(?i)(?:by|author)[:{space}]+([^\n]+)")


def author(content: Column) -> Column:
    """The stated author, else a line that is a name."""
    return js_trim(F.coalesce(stated_author(content), group(F.substring(content, 1, PREFIX), r"(?m)^([A-Z][a-z]+ [A-Z][a-z]+)\s*$")))


def version(content: Column) -> Column:
    return group(F.substring(content, 1, PREFIX), r"(?i)version[:\s]+([0-9.]+)")


def platform(content: Column, names: tuple[str, ...] = PLATFORMS) -> Column:
    """A name's pattern is tried where the name stands in lower case."""

    def first(h: Column) -> Column:
        return F.coalesce(*[F.when(h["low"].contains(p.lower()) & h["own"].rlike(rf"(?i)(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), F.lit(p)) for p in names])

    head = F.substring(content, 1, PLATFORM_PREFIX)
    return let(F.struct(head.alias("own"), F.lower(head).alias("low")), first)


def ascii_art(content: Column) -> Column:
    def drawn(line: Column) -> Column:
        return (F.length(line) > 10) & (F.length(F.regexp_replace(line, r"[\w\s]+", "")) > 0.3 * F.length(line))

    return F.size(F.filter(F.slice(F.split(content, "\n", ART_LINES + 1), 1, ART_LINES), drawn)) > 5


def _holds(text: Column, pattern: str) -> Column:
    """rlike(), but alternatives of plain letters are sought as they are, and those with a dot only where what is before it stands."""
    each = pattern.split("|")
    if not all(re.fullmatch("[a-z0-9 :%]+([.][a-z0-9 :%]+)*", k) for k in each):
        return text.rlike(pattern)
    return reduce(or_, [text.contains(k) if "." not in k else text.contains(k.split(".")[0]) & text.rlike(k) for k in each])


def auto_tags(content: Column, path: Column, rules: tuple = CONTENT_TAGS) -> Column:
    name = F.lower(basename(path))

    def marks(head: Column) -> Column:
        own = [F.when(name.contains(k), F.lit(t)) for k, t in FILENAME_TAGS]
        return F.array(*own, *[F.when(_holds(head, k) | ascii_art(content) if t == "ASCII Art" else _holds(head, k), F.lit(t)) for k, t in rules])

    return F.array_distinct(F.array_compact(let(F.lower(F.substring(content, 1, PREFIX)), marks)))


def normalize_platform(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PLATFORM_DIRS.items() for x in kv])
    return F.try_element_at(table, F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))


def game_from_filename(path: Column) -> Column:
    """struct(external_id, name)."""
    parts = F.split(F.regexp_extract(stem(path), r"^(\d+)-(.+)$", 2), "-")

    def named(p: Column) -> Column:
        stop = F.array_position(F.transform(p, lambda x: F.lower(x).isin(*SECTION_WORDS)), F.lit(True))
        kept = F.when(stop > 0, F.slice(p, F.lit(1), (stop - 1).cast("int"))).otherwise(p)
        return F.coalesce(blank_null(F.array_join(F.transform(kept, _upper_first), " ")), F.lit("Unknown Game"))

    own = group(stem(path), r"^(\d+)-(.+)$")
    return F.struct(own.alias("external_id"), F.when(own.isNotNull(), let(parts, named)).otherwise(title_from_filename(path)).alias("name"))


def game_from_path(path: Column) -> Column:
    """struct(external_id, name, platform): from the folders around `faqs`, else from the file name."""

    def at(parts: Column) -> Column:
        k = F.array_position(F.transform(parts, F.lower), "faqs").cast("int")
        folder = F.get(parts, k - 2)
        told = (k > 1) & folder.rlike(r"^\d+-.+$")
        slug = F.array_join(F.transform(F.split(F.regexp_extract(folder, r"^(\d+)-(.+)$", 2), "-"), _upper_first), " ")
        other = game_from_filename(path)
        return F.struct(
            F.when(told, F.regexp_extract(folder, r"^(\d+)-", 1)).otherwise(other["external_id"]).alias("external_id"),
            F.when(told, slug).otherwise(other["name"]).alias("name"),
            F.when(told & (k > 2), normalize_platform(F.get(parts, k - 3))).alias("platform"),
        )

    return let(F.split(path, "/"), at)


def opened(content: Column, path: Column) -> dict[str, Column]:
    """format, title and content of a file by its format, and whether it is bare: there is nothing to look into."""
    kind, empty = detect_format(path), ~content.rlike(NOT_WS)
    name = title_from_filename(path)
    is_txt = (kind == "txt") & empty
    text = F.when(is_txt, F.lit(EMPTY_CONTENT)).when(kind == "html", html_to_text(content)).when(kind == "pdf", F.concat(F.lit(PDF_CONTENT), basename(path))).otherwise(content)
    found = F.when(kind == "txt", title_from_content(content)).when(kind == "html", html_title(content)).when(kind == "md", markdown_title(content))
    title = F.when(is_txt, F.concat(name, F.lit(" (Empty Guide)"))).otherwise(F.coalesce(blank_null(found), name))
    return {"format": kind, "title": title, "content": text, "bare": is_txt | (kind == "pdf")}


def told(content: Column, bare: Column) -> dict[str, Column]:
    """author, version and platform, as the content of a file that is opened tells them."""
    return {k: F.when(~bare, f(content)) for k, f in {"author": author, "version": version, "platform": platform}.items()}


def parse(content: Column, path: Column) -> Column:
    """struct(format, title, content, author, version, platform) of a file by its format."""
    named = lambda own: [c.alias(k) for k, c in own.items()]
    return let(F.struct(*named(opened(content, path))), lambda s: F.struct(*[s[k].alias(k) for k in ("format", "title", "content")], *named(told(s["content"], s["bare"]))))


def download_name(title: Column, fmt: Column) -> Column:
    c = F.concat(title, F.lit("."), fmt)
    for a, b in ((r"\\", "_"), ('"', "'"), ("\r", ""), ("\n", " "), (f"{WS}+", " ")):
        c = F.regexp_replace(c, a, b)
    return F.coalesce(blank_null(js_trim(c)), F.lit("download"))


def mime(fmt: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), fmt), F.lit("text/plain"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_ascii(c: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case only; % and _ in the pattern are wildcards and no character escapes them."""
    return ascii_lower(c).like(ascii_lower_str(pattern).replace("\\", "\\\\"))


def ascii_lower_str(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def completion(pct: Column) -> Column:
    """struct(completion_percentage, status)."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct.cast("double")))
    return let(c, lambda x: F.struct(x.alias("completion_percentage"), F.when(x == 0, "not_started").when(x == 100, "completed").otherwise("in_progress").alias("status")))


def make_id(*cols: Column) -> Column:
    """A stable id in place of a random one, so that a load can run again."""
    return F.substring(F.sha2(F.concat_ws("\0", *cols), 256), 1, 21)
