"""Detectors that look at one page: all in one pass over the pages.

``HTML`` marks those that only look at pages with parsed HTML; others give an
observation for every page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import fixed as X
from lodestar.functions.robots import blocked_of
from lodestar.operators.audit import NETLOC, NOINDEX, Audit, same_site
from lodestar.operators.ladder import ERROR, FAIL, NA, PASS, WARN, Rung, verdict

HTML = True
PAGE: dict[str, tuple[bool, list[Rung]]] = {}

#: fixed values: link texts that say nothing, in six languages
GENERIC_LINKS = (
    "click here;click;here;read more;more;learn more;more info;more information;details;link;this link;this;go;continue;see more;view more;find out more;"
    "klicka här;här;läs mer;mer;se mer;visa mer;mer info;länk;hier;hier klicken;mehr;weiterlesen;mehr erfahren;mehr lesen;"
    "ici;cliquez ici;en savoir plus;lire la suite;plus;suite;aquí;haga clic aquí;haz clic aquí;leer más;más;ver más;saber más;klik hier;lees meer;meer"
).split(";")
_EDGE = r"[\\s.,:;!?…»«›‹→←>|\"\'()\\[\\]\\-]+"
_PLAIN_LINK = f"regexp_replace(regexp_replace(regexp_replace(lower({{}}), '(?U){_EDGE}$', ''), '(?U)^{_EDGE}', ''), '(?U)\\\\s+', ' ')"
#: bytes of a file that a search crawler reads: as decimal and as binary megabytes
LIMIT, PDF_LIMIT = (2_000_000, 2 * 1024**2), (64_000_000, 64 * 1024**2)
MARGIN = 0.75


def page(name: str, html: bool, *rungs: Rung) -> None:
    PAGE[name] = html, list(rungs)


def _n(array: str, where: str) -> str:
    return f"size(filter({array}, i -> {where}))"


page(
    "http-status", False,
    (FAIL, "f.error is not null", "Request failed: {f.error}"),
    (FAIL, "f.status is null", "The response has no status."),
    (FAIL, "f.status >= 500", "Server error {f.status}."),
    (FAIL, "f.status >= 400", "Client error {f.status}{if(discovered_from is null, '', ', linked from a crawled page')}."),
    (PASS, "true", "Responded {f.status}."),
)
page(
    "redirect-chain", False,
    (PASS, "hops = 0", "Reached directly."),
    (WARN, "hops > 1", "{hops} redirects before the final URL."),
    (WARN, "true", "One redirect before the final URL."),
)
page("https-enforcement", False, (FAIL, "not startswith(f.final_url, 'https://')", "The final URL is plain HTTP."), (PASS, "true", "Served over HTTPS."))
_INSECURE = "size(filter(concat(x.scripts, transform(x.images, i -> coalesce(i.src, ''))), u -> startswith(u, 'http://')))"
page(
    "mixed-content", HTML,
    (NA, "not startswith(f.final_url, 'https://')", "The page is not served over HTTPS."),
    (FAIL, f"{_INSECURE} > 0", f"{{{_INSECURE}}} subresource(s) over plain HTTP."),
    (PASS, "true", "All subresources are over HTTPS."),
)
_HEADERS = (
    "array_compact(array(if(startswith(f.final_url, 'https://') and f.headers['strict-transport-security'] is null, 'strict-transport-security', null), "
    "if(coalesce(lower(f.headers['x-content-type-options']), '') <> 'nosniff', 'x-content-type-options: nosniff', null), "
    "if(f.headers['content-security-policy'] is null and f.headers['x-frame-options'] is null, 'content-security-policy or x-frame-options', null), "
    "if(f.headers['referrer-policy'] is null, 'referrer-policy', null)))"
)
page("security-headers", False, (PASS, f"size({_HEADERS}) = 0", "All baseline security headers are there."), (WARN, "true", f"Missing: {{array_join({_HEADERS}, ', ')}}."))
_DELIVERY = "f.headers['content-encoding'] is null"
_CACHE = "f.headers['cache-control'] is null and f.headers['etag'] is null"
page(
    "compression-cache", False,
    (NA, "not rlike(coalesce(f.content_type, ''), '(?i)^(text/|application/(javascript|json|xml|xhtml[+]xml))')", "Content type {coalesce(f.content_type, 'unknown')} is not text."),
    (WARN, f"{_DELIVERY} or ({_CACHE})", f"Delivery: {{concat_ws('; ', if({_DELIVERY}, 'no content-encoding', null), if({_CACHE}, 'no cache-control or etag', null))}}."),
    (PASS, "true", "Compressed and cacheable."),
)
_CONTROL = "transform(split(lower(coalesce(f.headers['cache-control'], '')), ','), d -> trim(d))"
_VARY = "transform(split(lower(coalesce(f.headers['vary'], '')), ','), d -> trim(d))"
page(
    "private-response-caching", False,
    (NA, f"not array_contains({_CONTROL}, 'public')", "Not declared publicly cacheable."),
    (FAIL, "f.headers['set-cookie'] is not null", "Sets a cookie while publicly cacheable."),
    (FAIL, f"array_contains({_VARY}, 'cookie')", "Varies by cookie while publicly cacheable."),
    (PASS, "true", "Publicly cacheable, without a cookie."),
)
page(
    "x-robots-tag-non-html", False,
    (NA, "f.status is null or f.status <> 200", "Response was not a 200."),
    (NA, "coalesce(f.content_type, '') = '' or rlike(f.content_type, '(?i)^(text/html|application/xhtml[+]xml)')", "Response is HTML."),
    (NA, "not array_contains(flags, 'non-html-files')", "The site does not claim indexable files."),
    (WARN, "f.headers['x-robots-tag'] is null", "{f.content_type} is served with no X-Robots-Tag."),
    (PASS, "true", "X-Robots-Tag: {f.headers['x-robots-tag']}"),
)

page(
    "canonicalization", HTML,
    (WARN, "x.canonical is null", "No rel=canonical."),
    (FAIL, "x.canonical_target is null", "rel=canonical is not a usable URL: {x.canonical}"),
    (PASS, "x.canonical_target = final_target", "Self-referencing canonical."),
    (WARN, "true", "Canonical points at a different URL."),
)
_LONG = "length(encode({}, 'UTF-16BE')) / 2"
_DESC = _LONG.format("x.meta_description")
page(
    "meta-description", HTML,
    (NA, "meta_noindex", "The page is noindex."),
    (FAIL, "coalesce(x.meta_description, '') = ''", "No meta description."),
    (WARN, f"{_DESC} < 50 or {_DESC} > 160", f"Meta description is {{bigint({_DESC})}} characters."),
    (PASS, "true", "A meta description is there."),
)
_OG = "array_compact(transform(array('og:title', 'og:description', 'og:image', 'og:url'), k -> if(x.open_graph[k] is null, k, null)))"
page("social-metadata", HTML, (FAIL, f"size({_OG}) = 4", "No Open Graph metadata."), (WARN, f"size({_OG}) > 0", f"Missing {{array_join({_OG}, ', ')}}."), (PASS, "true", "Open Graph metadata is there."))
_TYPES = "flatten(transform(x.json_ld_nodes, n -> n.types))"
_HIERARCHY: list[Rung] = [
    (NA, "not array_contains(flags, 'hierarchical')", "The site does not claim hierarchical content."),
    (NA, "depth = 0", "The home page is above any trail."),
]
page(
    "breadcrumblist-schema", HTML, *_HIERARCHY,
    (FAIL, "x.json_ld_errors > 0", "{x.json_ld_errors} JSON-LD block(s) do not parse."),
    (PASS, f"array_contains({_TYPES}, 'BreadcrumbList')", "BreadcrumbList is there."),
    (FAIL, "true", "No BreadcrumbList below the root."),
)

_NO_IMAGES: Rung = (NA, "size(x.images) = 0", "The page has no images.")
_FILE_ALT = "rlike(i.alt, '(?i)^[\\\\w. -]+[.](jpe?g|png|gif|webp|avif|svg)$')"
page(
    "image-alt-quality", HTML, _NO_IMAGES,
    (FAIL, "exists(x.images, i -> i.alt is null)", f"{{{_n('x.images', 'i.alt is null')}}} of {{size(x.images)}} image(s) have no alt."),
    (WARN, f"exists(x.images, i -> {_FILE_ALT})", f"{{{_n('x.images', _FILE_ALT)}}} image(s) use a file name as alt."),
    (PASS, "true", "All {size(x.images)} image(s) declare alt."),
)
_UNSIZED = "i.width is null or i.height is null"
page(
    "image-dimensions", HTML, _NO_IMAGES,
    (FAIL, f"exists(x.images, i -> {_UNSIZED})", f"{{{_n('x.images', _UNSIZED)}}} of {{size(x.images)}} image(s) have no width or height."),
    (PASS, "true", "All {size(x.images)} image(s) declare their size."),
)
page(
    "responsive-media", HTML,
    (FAIL, "not x.has_viewport_meta", "No viewport meta."),
    (PASS, "size(x.images) = 0", "Viewport meta, no images."),
    (WARN, "exists(x.images, i -> not i.has_srcset)", f"{{{_n('x.images', 'not i.has_srcset')}}} of {{size(x.images)}} image(s) have one fixed source."),
    (PASS, "true", "Viewport meta, and all images have a srcset."),
)
_LAZY = "lower(trim(coalesce({}.loading, ''))) = 'lazy'"
_PAINTS = "array_compact(array(r.largest_paint, m.largest_paint))"
page(
    "lcp-not-lazy", HTML,
    (FAIL, f"exists({_PAINTS}, i -> i.element = 'img' and {_LAZY.format('i')})", "The largest paint is a lazy image."),
    (PASS, f"size({_PAINTS}) > 0", "The largest paint is not lazy."),
    _NO_IMAGES,
    (WARN, _LAZY.format("get(x.images, 0)"), "The first image is lazy, and no render says what the largest paint is."),
    (PASS, "true", "The first image loads eagerly."),
)
_HEARD = "filter(x.media, i -> not i.ambient)"
_SILENT = "not i.has_captions and not i.has_fallback_text"
page(
    "media-alternatives", HTML,
    (NA, "size(x.media) = 0", "The page has no video or audio."),
    (NA, f"size({_HEARD}) = 0", "All videos are decoration."),
    (FAIL, f"exists({_HEARD}, i -> {_SILENT})", f"{{{_n(_HEARD, _SILENT)}}} of {{size({_HEARD})}} have no captions and no text."),
    (WARN, f"exists({_HEARD}, i -> not i.has_captions)", f"{{{_n(_HEARD, 'not i.has_captions')}}} have text but no captions."),
    (PASS, "true", f"All {{size({_HEARD})}} declare captions."),
)
page(
    "image-discoverability", HTML,
    (NA, "coalesce(x.open_graph['og:image'], x.twitter['twitter:image']) is null", "No representative image is declared."),
    (NA, "size(shown_image) = 0", "The representative image's URL can't be resolved."),
    (PASS, f"not {same_site('get(shown_image, 0)')}", "The representative image is off-site."),
    (FAIL, "size(image_blocked) > 0", "robots.txt keeps the image crawler from the representative image."),
    (PASS, "true", "The representative image may be crawled."),
)

_BARRIERS = (
    f"array_compact(array(if(exists(x.links, i -> i.name = ''), concat({_n('x.links', 'i.name = ' + repr(''))}, ' link(s) have no name'), null), "
    f"if(exists(x.images, i -> i.alt is null and not i.alt_exempt), concat({_n('x.images', 'i.alt is null and not i.alt_exempt')}, ' image(s) have no alt'), null), "
    "if(trim(coalesce(x.lang, '')) = '', 'no language is declared', null)))"
)
_GENERIC = f"array_contains(array({', '.join(repr(g) for g in GENERIC_LINKS)}), {_PLAIN_LINK.format('i.name')})"
_HEADERLESS = "not i.presentational and not i.has_headers and i.rows >= 2 and i.columns >= 2"
_UNCAPTIONED = "i.kind = 'video' and not i.ambient and not i.has_captions"
_DOUBTS = (
    f"array_compact(array(if(exists(x.links, i -> {_GENERIC}), concat({_n('x.links', _GENERIC)}, ' link(s) have generic names'), null), "
    f"if(exists(x.tables, i -> {_HEADERLESS}), concat({_n('x.tables', _HEADERLESS)}, ' table(s) have no headers'), null), "
    f"if(exists(x.media, i -> {_UNCAPTIONED}), concat({_n('x.media', _UNCAPTIONED)}, ' video(s) have no captions'), null)))"
)
_NOT_200: Rung = (NA, "f.status is null or f.status <> 200", "Response was not a 200.")
page(
    "content-accessibility", HTML, _NOT_200,
    (FAIL, f"size({_BARRIERS}) > 0", f"Barriers: {{array_join(concat({_BARRIERS}, {_DOUBTS}), '; ')}}."),
    (WARN, f"size({_DOUBTS}) > 0", f"To settle: {{array_join({_DOUBTS}, '; ')}}."),
    (PASS, "true", "Markup shows no barrier."),
)
_AXE = "r.accessibility.violations"
_GRAVE = "coalesce(i.impact in ('critical', 'serious'), false)"
page(
    "axe-accessibility", HTML,
    (NA, "r.accessibility is null", "No accessibility run on this page."),
    (ERROR, "r.accessibility.error is not null", "The accessibility run failed: {r.accessibility.error}."),
    (FAIL, f"exists({_AXE}, i -> {_GRAVE})", f"{{{_n(_AXE, _GRAVE)}}} critical or serious violation(s): {{array_join(transform(filter({_AXE}, i -> {_GRAVE}), i -> i.id), ', ')}}."),
    (WARN, f"size({_AXE}) > 0", f"{{size({_AXE})}} lesser violation(s)."),
    (PASS, "true", "No violations."),
)
_DESK = "coalesce(r.extracted, x)"
_H1 = "trim(coalesce(try_element_at(filter({}.headings, i -> i.level = 1), 1).text, ''))"
_DROPPED = (
    f"array_compact(array(if(coalesce({_DESK}.title, '') <> '' and coalesce(m.extracted.title, '') = '', 'title', null), "
    f"if({_H1.format(_DESK)} <> '' and {_H1.format('m.extracted')} = '', 'first h1', null), "
    f"if({_DESK}.canonical is not null and m.extracted.canonical is null, 'canonical', null), "
    f"if(rlike(coalesce(m.extracted.meta_robots, ''), '{NOINDEX}') and not rlike(coalesce({_DESK}.meta_robots, ''), '{NOINDEX}'), 'noindex added', null)))"
)


def _halved(a: str, b: str) -> str:
    return f"({a} >= 10 and {b} * 2 < {a})"


page(
    "mobile-journey-qa", HTML,
    (NA, "m is null", "No mobile render."),
    (ERROR, "m.error is not null", "The mobile render failed: {m.error}."),
    (ERROR, "m.extracted is null", "The mobile render has no HTML."),
    (FAIL, f"size({_DROPPED}) > 0", f"The mobile render drops or changes: {{array_join({_DROPPED}, ', ')}}."),
    (WARN, f"not m.extracted.has_viewport_meta or {_halved(_DESK + '.word_count', 'm.extracted.word_count')} or {_halved(f'size({_DESK}.links)', 'size(m.extracted.links)')}", "The mobile render has no viewport, or less than half the words or links."),
    (PASS, "true", "The mobile render keeps signals and content."),
)

_RENDERED: list[Rung] = [
    (NA, "r is null", "No render was captured."),
    (ERROR, "r.error is not null", "Rendering failed: {r.error}."),
    (ERROR, "r.extracted is null", "The rendered response has no HTML."),
]


def _gap(raw: str, shown: str, least: int) -> str:
    return f"({shown} > {raw} * 1.5 and {shown} - {raw} >= {least})"


_MORE_JSON = "size(r.extracted.json_ld_nodes) > size(x.json_ld_nodes)"
page(
    "rendering-strategy-classifier", HTML, *_RENDERED,
    (FAIL, f"meta_noindex <> rlike(coalesce(r.extracted.meta_robots, ''), '{NOINDEX}')", "Raw and rendered differ on noindex."),
    (FAIL, "not (x.canonical <=> r.extracted.canonical)", "Raw and rendered differ on the canonical."),
    (FAIL, "x.word_count = 0 and r.extracted.word_count > 0", "The raw response has no words."),
    (WARN, f"{_gap('x.word_count', 'r.extracted.word_count', 50)} or {_gap('size(x.links)', 'size(r.extracted.links)', 5)} or {_MORE_JSON}", "Rendering adds meaningfully to the raw response."),
    (PASS, "true", "Raw and rendered agree."),
)
_TARGETS = "array_distinct(transform(filter({}.links, i -> i.target is not null and " + same_site("i.url") + "), i -> i.target))"
_REMOVED = f"array_except({_TARGETS.format('x')}, {_TARGETS.format('r.extracted')})"
_ADDED = f"array_except({_TARGETS.format('r.extracted')}, {_TARGETS.format('x')})"
_FIRST = "try_element_at(filter({}.headings, i -> i.level = 1), 1).text"
page(
    "raw-rendered-parity", HTML, *_RENDERED,
    (FAIL, f"not (x.title <=> r.extracted.title) or not ({_FIRST.format('x')} <=> {_FIRST.format('r.extracted')}) or size({_REMOVED}) > 0", f"Raw and rendered disagree on title, first h1 or links ({{size({_REMOVED})}} removed)."),
    (WARN, f"size({_ADDED}) > 0", f"{{size({_ADDED})}} link target(s) exist only after rendering."),
    (PASS, "true", "Raw and rendered carry the same title, h1 and links."),
)
_IDS = "transform(filter({}.json_ld_nodes, n -> size(n.types) > 0), n -> concat_ws('|', array_join(n.types, ','), coalesce(n.id, '')))"
page(
    "schema-validation-parity", HTML, *_RENDERED,
    (FAIL, "x.json_ld_errors > 0 or r.extracted.json_ld_errors > 0", "JSON-LD does not parse."),
    (FAIL, f"size(array_except({_IDS.format('x')}, {_IDS.format('r.extracted')})) > 0", "A type or id is gone after rendering."),
    (WARN, f"size(array_except({_IDS.format('r.extracted')}, {_IDS.format('x')})) > 0", "Rendering adds structured data."),
    (PASS, "true", "Raw and rendered carry the same structured data."),
)

page(
    "indexability-matrix-reconciliation", HTML,
    (NA, "size(resources) = 0", "Neither stylesheets nor scripts to crawl."),
    (PASS, "size(own_resources) = 0", "All stylesheets and scripts are off-site."),
    (FAIL, "size(array_intersect(resources_blocked, x.stylesheets)) > 0", "robots.txt blocks {size(array_intersect(resources_blocked, x.stylesheets))} stylesheet(s)."),
    (WARN, "size(resources_blocked) > 0", "robots.txt blocks {size(resources_blocked)} script(s)."),
    (PASS, "true", "All {size(own_resources)} own stylesheets and scripts may be crawled."),
)

_FILLER, _MARKER = X.FILLER, X.MARKER
_READ = "aggregate(x.content.sections, 0, (n, s) -> n + s.words)"
page(
    "launch-content-completeness", HTML, _NOT_200,
    (NA, "any_noindex", "The page is noindex."),
    (ERROR, "f.truncated", "The body was cut."),
    (FAIL, f"{_READ} = 0", "The page has no reading matter."),
    (FAIL, f"rlike(x.content.text, '{_FILLER}') or rlike(x.content.text, '{_MARKER}')", "Placeholder text is left."),
    (WARN, f"{_READ} < 50", f"Only {{{_READ}}} words of reading matter."),
    (PASS, "true", f"{{{_READ}}} words, no placeholder."),
)
#: whether a page declares itself an article
IS_ARTICLE = "(x.derived.article is not null or (lower(coalesce(x.open_graph['og:type'], '')) = 'article' and coalesce(x.authorship.published_time, '') <> ''))"
_SECTIONS = "x.content.sections"
_WORDS = f"aggregate({_SECTIONS}, 0, (n, s) -> n + s.words)"
#: a question heading with nothing said before the next heading of its level or above
_UNANSWERED = (
    f"exists(sequence(0, size({_SECTIONS}) - 1), k -> {_SECTIONS}[k].heading is not null and endswith(trim({_SECTIONS}[k].heading.text), '?') "
    f"and aggregate(slice({_SECTIONS}, k + 2, size({_SECTIONS})), named_struct('open', true, 'words', {_SECTIONS}[k].words), "
    f"(a, s) -> if(a.open and s.heading.level > {_SECTIONS}[k].heading.level, named_struct('open', true, 'words', a.words + s.words), named_struct('open', false, 'words', a.words))).words = 0)"
)
page(
    "answer-first-structure", HTML, _NOT_200,
    (ERROR, "f.truncated", "The body was cut."),
    (NA, f"{_WORDS} < 300 and not {IS_ARTICLE}", "Too little reading matter."),
    (WARN, f"{_WORDS} >= 600 and not exists({_SECTIONS}, s -> s.heading.level >= 2)", f"{{{_WORDS}}} words without a heading."),
    (WARN, f"size({_SECTIONS}) > 0 and {_UNANSWERED}", "A question heading is not answered."),
    (PASS, "true", "Sections are headed, and questions are answered."),
)

# detectors whose rules are our own: only their names and bindings are known
page(
    "crawlable-links", HTML,
    (NA, "size(x.links) = 0", "The page has no links."),
    (FAIL, "exists(x.links, i -> rlike(i.href, '(?i)^\\\\s*javascript:'))", f"{{{_n('x.links', 'rlike(i.href, ' + repr('(?i)^javascript:') + ')')}}} link(s) lead to scripts."),
    (PASS, "true", "All links are addresses."),
)
_LEVELS = "transform(x.headings, i -> i.level)"
_SKIPS = f"exists(sequence(1, size(x.headings) - 1), k -> {_LEVELS}[k] > {_LEVELS}[k - 1] + 1)"
page(
    "heading-outline", HTML,
    (FAIL, f"not array_contains({_LEVELS}, 1)", "No h1."),
    (WARN, f"size(x.headings) > 1 and {_SKIPS}", "The outline skips a level."),
    (PASS, "true", "The outline begins with h1 and skips no level."),
)
page(
    "primary-heading", HTML,
    (FAIL, f"not exists(x.headings, i -> i.level = 1 and i.text <> '')", "No h1."),
    (WARN, f"{_n('x.headings', 'i.level = 1')} > 1", f"{{{_n('x.headings', 'i.level = 1')}}} h1 headings."),
    (PASS, "true", "One h1."),
)
page("semantic-html", HTML, (WARN, "not array_contains(x.landmarks, 'main')", "No main landmark."), (PASS, "true", "A main landmark is there."))
page(
    "lang-attribute", HTML,
    (FAIL, "trim(coalesce(x.lang, '')) = ''", "No language is declared."),
    (FAIL, "not rlike(trim(x.lang), '(?i)^[a-z]{2,3}(-[a-z0-9]{2,8})*$')", "The language {x.lang} is no language tag."),
    (PASS, "true", "Language {x.lang}."),
)
_GONE = "(?i)(page )?not found|\\\\b404\\\\b|does not exist|no longer available"
page(
    "soft-404", HTML, _NOT_200,
    (FAIL, f"(rlike(coalesce(x.title, ''), '{_GONE}') or exists(x.headings, i -> i.level = 1 and rlike(i.text, '{_GONE}'))) and x.word_count < 200", "A 200 that says it was not found."),
    (PASS, "true", "The page is there."),
)
_TAG = "(?i)googletagmanager[.]com/(gtag|gtm)|gtag\\\\(\\'config\\'"
_DEFAULT = "(?i)gtag\\\\(\\\\s*[\"\\']consent[\"\\']\\\\s*,\\\\s*[\"\\']default[\"\\']"
_CMP = "(?i)cookiebot|onetrust|cookielaw|usercentrics|didomi|quantcast|trustarc|iubenda"
_AT = "array_position(transform(x.script_tags, i -> rlike(concat(coalesce(i.src, ''), ' ', i.text), '{}')), true)"
page(
    "consent-mode-config", HTML,
    (NA, f"{_AT.format(_TAG)} = 0", "No analytics tag."),
    (FAIL, f"{_AT.format(_DEFAULT)} > {_AT.format(_TAG)}", "The consent default comes after the tag."),
    (FAIL, f"{_AT.format(_DEFAULT)} = 0 and {_AT.format(_CMP)} > 0", "A consent platform without a default."),
    (WARN, f"{_AT.format(_DEFAULT)} = 0", "Neither a consent default nor a platform."),
    (PASS, "true", "The consent default comes first."),
)


def measured(fetch: str) -> str:
    """SQL: struct (bytes, exact) of a response's size."""
    declared = f"try_cast({fetch}.headers['content-length'] as bigint)"
    plain = f"coalesce(lower(trim({fetch}.headers['content-encoding'])), 'identity') = 'identity'"
    return (
        f"case when not {fetch}.truncated then named_struct('bytes', {fetch}.byte_length, 'exact', true) "
        f"when {plain} and {declared} >= {fetch}.byte_length then named_struct('bytes', {declared}, 'exact', true) "
        f"else named_struct('bytes', {fetch}.byte_length, 'exact', false) end"
    )


def severity(size: str, limit: tuple[int, int] | str) -> str:
    """SQL: 0 pass, 1 warn, 2 error, 3 fail for a measured size against a limit."""
    decimal, binary = (f"{limit}.decimal", f"{limit}.binary") if isinstance(limit, str) else map(str, limit)
    return f"case when {size}.bytes > {binary} then 3 when not {size}.exact then 2 when {size}.bytes >= {decimal} * {MARGIN} then 1 else 0 end"


def page_facts(audit: Audit) -> DataFrame:
    """Page facts with what robots.txt says about a page's resources."""
    from lodestar.functions import url as U

    own = f"filter(resources, u -> {NETLOC.format('u')} = site_netloc)"
    image = F.expr("coalesce(x.open_graph['og:image'], x.twitter['twitter:image'])")
    shown = F.when(image.isNotNull(), F.array_compact(F.array(U.read_against(image, F.col("url")))))
    out = audit.facts.withColumn("resources", F.expr("array_distinct(concat(x.stylesheets, x.scripts))")).withColumn("own_resources", F.expr(own)).withColumn("shown_image", shown)
    return (
        out.withColumn("final_target", U.normalized(F.col("f.final_url")))
        .withColumn("resources_blocked", blocked_of(F.col("robots_txt"), "Googlebot", F.col("own_resources")))
        .withColumn("image_blocked", blocked_of(F.col("robots_txt"), "Googlebot-Image", F.col("shown_image")))
    )


def page_observations(audit: Audit, names: list[str] | None = None) -> DataFrame:
    """Observations of all page detectors, or of some, from one scan of the pages."""
    chosen = PAGE if names is None else {n: PAGE[n] for n in names}
    each = [
        F.when(F.col("is_html") if html else F.lit(True), F.struct(F.lit(name).alias("probe_id"), verdict(rungs).alias("v"))) for name, (html, rungs) in chosen.items()
    ]
    rows = page_facts(audit).select("crawl_id", F.col("normalized_url").alias("page_url"), F.explode(F.array_compact(F.array(*each))).alias("o"))
    return rows.select("crawl_id", "o.probe_id", F.lit("page").alias("scope"), "page_url", "o.v.outcome", "o.v.summary", F.lit(None).cast("string").alias("data"))
