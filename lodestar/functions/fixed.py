"""Patterns and names by which pages, links and URLs are told apart.

They have to be what they are for outcomes to be right; all are Java regular
expressions as SQL literals hold them (backslashes doubled) unless said otherwise.
"""

from __future__ import annotations

#: content types that are no documents
NO_DOCUMENT = "^(image|video|audio|font)/|^application/(octet-stream|zip|gzip|x-gzip|wasm)$"
#: path segments of pages that declare themselves sponsored
SPONSORED = "(?i)^(sponsored|sponsor(ed)?-content|paid-?posts?|paid-?content|partner-?content|advertorials?|brand-?studio)$"
#: words that disclose sponsoring
DISCLOSED = "(?i)sponsored|paid (post|content|partnership|for by)|advertisement|advertorial|advertiser content|promoted by"
#: internal search: paths, and query parameters
SEARCH_PATH = "(?i)/(search|suche|recherche|busca|resultater)\\\\b"
SEARCH_NAMES = ("q", "s", "query", "search", "keyword", "keywords")
#: session identifiers among query parameters, and in paths
SESSION_NAMES = "(?i)^(jsessionid|phpsessid|aspsessionid\\\\w*|sessionid|session_id|sessid|cfid|cftoken|zenid|oscsid)$"
SESSION_PATH = "(?i);(jsessionid|phpsessid|sessionid)="
PAGE_NAMES = ("page", "p", "pg", "paged")
#: addresses of login pages
LOGIN = "(?i)(^|[/._-])(log-?in|sign-?in|sso|auth(enticate)?|account/login|session)([/._?-]|$)"
#: errors that tell of a redirect loop
LOOPING = "(?i)loop|too many redirects"
#: names of news and video sitemaps
NEWS_NAME, VIDEO_NAME = "(?i)(^|[^a-z])news([^a-z]|$)", "(?i)(^|[^a-z])videos?([^a-z]|$)"
#: link texts and path segments of contact and about pages of news sites
CONTACT_TEXT = "(?iu)^(contact( us)?|kontakt|contacto|contato|contatti|nous contacter|impressum)$"
CONTACT_PATH = "(?i)^(contact|contact-us|contactus|kontakt|contacto|contato|contatti|nous-contacter|impressum)([.]\\\\w+)?$"
ABOUT_TEXT = "(?iu)^(about( us)?|masthead|impressum|who we are|our story|om oss|über uns|qui sommes-nous|chi siamo|quiénes somos)$"
ABOUT_PATH = "(?i)^(about|about-us|about_us|aboutus|masthead|impressum|who-we-are|om-oss|ueber-uns|uber-uns|qui-sommes-nous|chi-siamo|quienes-somos)([.]\\\\w+)?$"
#: texts left by writers
FILLER = "(?i)lorem ipsum|coming soon|\\\\[insert"
MARKER = "(?<![.\\\\w])(?:TODO|TBD|XXX)\\\\b"
#: links within a page that page through it (a Python expression)
FRAGMENT_PAGE = r"#!?/?(?:page|p)[-_=/]?\d+"
