"""Fixed values that results depend on: vocabularies, entity list, tag groups."""

# Class and id words of elements unlikely to hold the article (searched), and words that overrule them.
UNLIKELY = "combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter|adblock|footer"
MAYBE = "and|article|body|column|main|shadow"
# Words at the start of a class or id that speak for or against an element.
POSITIVE = "article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
NEGATIVE = "combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget|adblock"
# Classes whose elements are always dropped (searched, case counts).
USELESS_CLASS = "comment|komment|modal|adblock|bottom_info"
# Elements stripped with their tail before anything else.
STRIPPED = ["blockquote", "code", "table", "ol", "ul", "embedded", "input", "address", "iframe", "textarea", "dl"]
# Base score of an element by its tag.
TAG_SCORES = {5: ["div"], 3: ["pre", "td", "blockquote"], -3: ["address", "ol", "ul", "dl", "dd", "dt", "li", "form"], -5: ["h1", "h2", "h3", "h4", "h5", "h6", "th"]}
# Image paths that are never, or only then, lead images (searched; a dot is any character).
IMAGE_DENY = ".gif|.ico|twitter.jpg|share|social|logo|/ads.|/ads/|button|notification|empty"
IMAGE_ALLOW = ".jpg|.jpeg|.png"
IMAGE_ENDS = [".jpg", "jpeg", "png"]
# Names of charsets read as a larger one.
CHARSET_ALIASES = {"big5": "big5hkscs", "gb2312": "gb18030", "ascii": "utf-8"}
# Character, its name and its number as entities that are unescaped.
ENTITIES = [
    (" ", "&nbsp;", "&#160;"), ("£", "&pound;", "&#163;"), ("€", "&euro;", "&#8364;"), ("¶", "&para;", "&#182;"), ("§", "&sect;", "&#167;"), ("©", "&copy;", "&#169;"), ("®", "&reg;", "&#174;"),
    ("™", "&trade;", "&#8482;"), ("°", "&deg;", "&#176;"), ("±", "&plusmn;", "&#177;"), ("¼", "&frac14;", "&#188;"), ("½", "&frac12;", "&#189;"), ("¾", "&frac34;", "&#190;"), ("×", "&times;", "&#215;"),
    ("÷", "&divide;", "&#247;"), ("ƒ", "&fnof;", "&#402;"), ("…", "&hellip;", "&#8230;"), ("′", "&prime;", "&#8242;"), ("″", "&Prime;", "&#8243;"), ("–", "&ndash;", "&#8211;"), ("—", "&mdash;", "&#8212;"),
    ('"', "&quot;", "&#34;"), ("'", "&apos;", "&#39;"), ("‘", "&lsquo;", "&#8216;"), ("’", "&rsquo;", "&#8217;"), ("‚", "&sbquo;", "&#8218;"), ("“", "&ldquo;", "&#8220;"), ("”", "&rdquo;", "&#8221;"), ("„", "&bdquo;", "&#8222;"),
    ("«", "&laquo;", "&#171;"), ("»", "&raquo;", "&#187;"),
]
# Title characters and entities brought to one form.
TITLE_DASHES = ["—", "–", "&mdash;", "&ndash;"]
TITLE_QUOTES = ["«", "»", "&quot;"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Accepted answers of a server.
GOOD_STATUS = [200, 301, 302]
