"""Main text of web pages: flat text blocks, neighbour features and a learned decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density
and those of its neighbours, whether it stands in the article or main element, how surely it stands
in page furniture (1 by tag, role, or as reader comments; 0.5 where only a class, an id or a form
hints at it), whether it is a heading, and whether it is a list item. A decision tree, grown on the small
labelled tables below, in part blocks of the generator's pages, keeps or drops each block. An article or main element ends the hints around it: a page whose
body, form or wrapper is named like a sidebar still has its article.

Null and empty pages give an empty text. Markup that is cut off, unclosed or out of order is read
as far as it goes, and in one pass: the work for a page follows its length, however deep it nests.
Long pages are read whole. Repeated rows are extracted each for themselves. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, tidy

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s*=\s*\"[^\"]*\"|\s*=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")
TOKENS = re.compile(r"[^a-z0-9]+")
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("head noscript template svg math canvas object select option button audio video".split())
#: Elements that a head may hold; any other start tag, and text, ends a head that is still open.
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
#: HTML elements that end an open svg or math, and elements inside of these that may hold HTML.
BREAKOUT = frozenset("article aside b big blockquote body br center code dd div dl dt em embed footer h1 h2 h3 h4 h5 h6 head header hr i img li main menu nav nobr ol p pre ruby s section small span strike strong sub sup table tt u ul var".split())
FOREIGN, FOREIGN_HOLDERS = frozenset(("svg", "math")), frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z|[\s\"'][^\s=\"']+/\Z")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Names of what readers wrote.
COMMENT_NAMES = frozenset("comment comments respond replies thread disqus discussion reviews".split())
#: Parts of class and id names that hint at page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert disclaimer footer login signup masthead menu modal nav navbar navigation newsletter"
    " pager pagination popup overlay promo promotion related recommended share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget skip".split()
)
OPEN_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Parts of names, and names of attributes, that stand for readers' words and for adverts however they are spelt.
COMMENT_PART = re.compile(r"comment(?!ar)|disqus")
ADVERT_PART = re.compile(r"^ads?(?:[sbuvzc](?:lot|ox|anner|lock|nit|iew|one|ontainer|ense|pace))?s?$|^advert|^sponsor")
ADVERT_ATTRIBUTE = re.compile(r"^data-(?:ads?(?:$|-)|ad(?:unit|slot|client|zone)|advert|google-query)")

#: words, link density, words before, density before, words after, density after, place (1 in article or main, 0 outside of one, 0.5 no such element), furniture, heading, list item; kept
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "furniture", "heading", "item")
#: Blocks of the generator's pages (page, block, features without the last, kept), read after the names and elements that tell an article from the rest were taken out of them: there only words and links decide.
PAGES = (
    (0, 17, (1, 0, 61, 0, 1, 0, 0.5, 0, 0), 1), (0, 18, (1, 0, 1, 0, 48, 0, 0.5, 0, 0), 1), (0, 34, (2, 0, 64, 0, 5, 0, 0.5, 0, 0), 1), (1, 15, (1, 0, 31, 0, 94, 0, 0.5, 0, 0), 1), (2, 20, (2, 0, 12, 0, 19, 0, 0.5, 0, 0), 1),
    (3, 0, (1, 1, 0, 0, 1, 1, 0.5, 0, 0), 0), (3, 1, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (3, 2, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (3, 3, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (3, 4, (1, 1, 1, 1, 8, 0, 0.5, 0, 0), 0),
    (3, 6, (14, 0, 8, 0, 35, 0, 0.5, 0, 1), 1), (3, 7, (35, 0, 14, 0, 17, 0, 0.5, 0, 0), 1), (3, 8, (17, 0, 35, 0, 49, 0, 0.5, 0, 0), 1), (3, 9, (49, 0, 17, 0, 143, 0, 0.5, 0, 0), 1), (3, 10, (143, 0, 49, 0, 11, 0, 0.5, 0, 0), 1),
    (5, 7, (2, 0, 11, 0, 2, 0, 0.5, 0, 1), 1), (5, 8, (2, 0, 2, 0, 32, 0, 0.5, 0, 0), 1), (6, 13, (1, 0, 12, 0, 161, 0, 0.5, 0, 0), 1), (10, 11, (2, 0, 20, 0, 53, 0, 0.5, 0, 0), 1), (10, 16, (3, 0, 1, 0, 43, 0, 0.5, 0, 0), 1),
    (17, 0, (1, 1, 0, 0, 1, 1, 0.5, 0, 0), 0), (17, 1, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (17, 2, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (17, 3, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (17, 4, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0),
    (17, 5, (1, 1, 1, 1, 9, 0, 0.5, 0, 0), 0), (17, 7, (4, 0, 9, 0, 4, 0, 0.5, 0, 1), 1), (17, 8, (4, 0, 4, 0, 28, 0, 0.5, 0, 0), 1), (17, 9, (28, 0, 4, 0, 55, 0, 0.5, 0, 0), 1), (17, 10, (55, 0, 28, 0, 7, 0, 0.5, 0, 0), 1),
    (17, 11, (7, 0, 55, 0, 10, 0, 0.5, 0, 0), 1), (17, 12, (10, 0, 7, 0, 4, 0, 0.5, 0, 0), 1), (17, 13, (4, 0, 10, 0, 8, 0, 0.5, 0, 0), 1), (17, 14, (8, 0, 4, 0, 17, 0, 0.5, 0, 0), 1), (17, 15, (17, 0, 8, 0, 23, 0, 0.5, 0, 0), 1),
    (17, 16, (23, 0, 17, 0, 113, 0, 0.5, 0, 0), 1), (17, 17, (113, 0, 23, 0, 44, 0, 0.5, 0, 0), 1), (17, 18, (44, 0, 113, 0, 17, 0, 0.5, 0, 0), 1), (17, 19, (17, 0, 44, 0, 1, 0, 0.5, 0, 0), 1),
    (17, 20, (1, 0, 17, 0, 8, 0, 0.5, 0, 0), 1), (17, 21, (8, 0, 1, 0, 60, 0, 0.5, 0, 0), 1), (17, 22, (60, 0, 8, 0, 8, 0, 0.5, 0, 0), 1), (17, 23, (8, 0, 60, 0, 9, 0, 0.5, 0, 0), 1), (17, 24, (9, 0, 8, 0, 12, 0, 0.5, 0, 0), 1),
    (18, 7, (1, 0, 9, 0, 1, 0, 0.5, 0, 1), 1), (18, 8, (1, 0, 1, 0, 5, 0, 0.5, 0, 0), 1), (19, 12, (3, 0, 195, 0, 10, 0, 0.5, 0, 0), 1), (20, 10, (3, 0, 49, 0, 40, 0, 0.5, 0, 0), 1), (21, 7, (2, 0, 10, 0, 2, 0, 0.5, 0, 1), 1),
    (24, 16, (2, 0, 9, 0, 45, 0, 0.5, 0, 0), 1), (27, 13, (2, 0, 22, 0, 139, 0, 0.5, 0, 0), 1), (28, 5, (3, 0, 12, 0, 3, 0, 0.5, 0, 1), 1), (29, 0, (1, 1, 0, 0, 1, 1, 0.5, 0, 0), 0), (29, 1, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0),
    (29, 2, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (29, 3, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (29, 4, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (29, 5, (1, 1, 1, 1, 4, 0, 0.5, 0, 0), 0), (29, 7, (7, 0, 4, 0, 96, 0, 0.5, 0, 1), 1),
    (29, 8, (96, 0, 7, 0, 2, 0, 0.5, 0, 0), 1), (29, 9, (2, 0, 96, 0, 2, 0, 0.5, 0, 0), 1), (29, 10, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 11, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 12, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1),
    (29, 13, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 14, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 15, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 16, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 17, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1),
    (29, 18, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 19, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 20, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 21, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 22, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1),
    (29, 23, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 24, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 25, (2, 0, 2, 0, 2, 0, 0.5, 0, 0), 1), (29, 26, (2, 0, 2, 0, 39, 0, 0.5, 0, 0), 1), (29, 27, (39, 0, 2, 0, 9, 0, 0.5, 0, 0), 1),
    (35, 9, (1, 0, 46, 0, 173, 0, 0.5, 0, 0), 1), (36, 12, (2, 0, 45, 0, 7, 0, 0.5, 0, 0), 1), (41, 0, (1, 1, 0, 0, 1, 1, 0.5, 0, 0), 0), (41, 1, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (41, 2, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0),
    (41, 3, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (41, 4, (1, 1, 1, 1, 1, 1, 0.5, 0, 0), 0), (41, 5, (1, 1, 1, 1, 4, 0, 0.5, 0, 0), 0), (41, 7, (10, 0, 4, 0, 23, 0, 0.5, 0, 1), 1), (41, 8, (23, 0, 10, 0, 4, 0, 0.5, 0, 0), 1),
    (41, 9, (4, 0, 23, 0, 1, 0, 0.5, 0, 0), 1), (41, 10, (1, 0, 4, 0, 253, 0, 0.5, 0, 0), 1), (41, 11, (253, 0, 1, 0, 19, 0, 0.5, 0, 0), 1), (41, 12, (19, 0, 253, 0, 11, 0, 0.5, 0, 0), 1), (41, 13, (11, 0, 19, 0, 11, 0, 0.5, 0, 0), 1),
    (41, 14, (11, 0, 11, 0, 36, 0, 0.5, 0, 0), 1), (41, 15, (36, 0, 11, 0, 4, 0, 0.5, 0, 0), 1), (41, 16, (4, 0, 36, 0, 13, 0, 0.5, 0, 0), 1), (41, 17, (13, 0, 4, 0, 1, 0, 0.5, 0, 0), 1), (41, 18, (1, 0, 13, 0, 10, 0, 0.5, 0, 0), 1),
    (41, 19, (10, 0, 1, 0, 8, 0, 0.5, 0, 0), 1), (43, 6, (2, 0, 4, 0, 2, 0, 0.5, 0, 1), 1), (45, 7, (1, 0, 8, 0, 1, 0, 0.5, 0, 1), 1), (46, 13, (3, 0, 9, 0, 15, 0, 0.5, 0, 0), 1), (47, 16, (1, 0, 61, 0, 1, 0, 0.5, 0, 0), 1),
    (49, 7, (2, 0, 12, 0, 2, 0, 0.5, 0, 1), 1), (51, 7, (1, 0, 35, 0, 44, 0, 0.5, 0, 0), 1), (53, 12, (2, 0, 15, 0, 11, 0, 0.5, 0, 0), 1), (55, 9, (3, 0, 10, 0, 84, 0, 0.5, 0, 0), 1), (58, 12, (2, 0, 87, 0, 12, 0, 0.5, 0, 0), 1),
    (59, 13, (2, 0, 22, 0, 139, 0, 0.5, 0, 0), 1),
)
WRITTEN = (
    # an article: title, byline, paragraphs of all lengths, lists, single links
    ((8, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1), 1), ((3, 0.0, 2, 1.0, 30, 0.0, 1, 0, 1), 1), ((4, 0.5, 9, 0.0, 70, 0.0, 1, 0, 0), 1), ((60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 0), 1), ((45, 0.05, 60, 0.0, 1, 0.0, 1, 0, 0), 1), ((300, 0.0, 9, 0.0, 5, 0.0, 1, 0, 0), 1),
    ((3, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1), 1), ((1, 0.0, 45, 0.0, 80, 0.0, 1, 0, 0), 1), ((2, 0.0, 30, 0.0, 12, 0.0, 1, 0, 0), 1), ((10, 0.3, 40, 0.0, 20, 0.0, 1, 0, 0), 1), ((6, 0.5, 5, 0.4, 7, 0.5, 1, 0, 0), 1), ((4, 1.0, 70, 0.0, 35, 0.0, 1, 0, 0), 1),
    ((7, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0), 1), ((30, 0.6, 30, 0.0, 30, 0.2, 1, 0, 0), 1), ((12, 0.0, 70, 0.0, 4, 1.0, 1, 0, 0), 1), ((1, 0.0, 1, 1.0, 1, 0.0, 1, 0, 0), 1), ((2, 0.0, 6, 1.0, 3, 0.0, 1, 0, 0), 1), ((1, 0.0, 3, 0.0, 3, 1.0, 1, 0, 0), 1), ((1, 1.0, 0, 0.0, 0, 0.0, 1, 0, 0), 1), ((1, 1.0, 1, 0.0, 1, 0.0, 1, 0, 0), 1), ((2, 1.0, 90, 0.0, 0, 0.0, 1, 0, 0), 1),
    ((60, 0.0, 0, 0.0, 3, 1.0, 1, 0, 0), 1), ((200, 0.0, 1, 1.0, 5, 1.0, 1, 0, 0), 1), ((12, 0.0, 0, 0.0, 4, 1.0, 1, 0, 0), 1), ((90, 0.1, 0, 0.0, 3, 1.0, 0.5, 0, 0), 1), ((25, 0.0, 2, 1.0, 4, 1.0, 0.5, 0, 0), 1), ((5, 0.0, 0, 0.0, 4, 1.0, 1, 0, 1), 1), ((6, 0.0, 2, 1.0, 5, 1.0, 1, 0, 0), 1), ((1, 0.0, 0, 0.0, 2, 1.0, 1, 0, 0), 1),
    # a paragraph of links or a linked sentence of an article stays
    ((3, 1.0, 60, 0.0, 50, 0.0, 1, 0, 0), 1), ((3, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0), 1), ((4, 1.0, 3, 1.0, 60, 0.0, 1, 0, 0), 1), ((6, 1.0, 5, 1.0, 4, 1.0, 1, 0, 0), 1), ((8, 1.0, 70, 0.0, 6, 1.0, 1, 0, 0), 1), ((5, 1.0, 4, 1.0, 0, 0.0, 1, 0, 0), 1), ((12, 1.0, 9, 1.0, 11, 1.0, 1, 0, 0), 1), ((2, 1.0, 2, 1.0, 8, 0.0, 1, 0, 0), 1),
    # hints of furniture inside an article: adverts, sign-ups and notices are short, a wrapper's paragraphs are not
    ((7, 0.0, 60, 0.0, 50, 0.0, 1, 0.5, 0), 0), ((25, 0.0, 60, 0.0, 70, 0.0, 1, 0.5, 0), 0), ((3, 1.0, 50, 0.0, 60, 0.0, 1, 0.5, 0), 0), ((30, 0.1, 60, 0.0, 0, 0.0, 1, 0.5, 0), 0), ((4, 0.0, 80, 0.0, 20, 0.0, 1, 0.5, 1), 0), ((1, 0.0, 5, 0.0, 7, 0.0, 1, 0.5, 0), 0),
    ((90, 0.0, 60, 0.0, 80, 0.0, 1, 0.5, 0), 1), ((64, 0.02, 50, 0.0, 70, 0.0, 1, 0.5, 0), 1), ((120, 0.0, 20, 0.0, 40, 0.0, 1, 0.5, 0), 1), ((80, 0.6, 60, 0.0, 40, 0.7, 1, 0.5, 0), 0), ((90, 0.9, 40, 0.0, 3, 1.0, 1, 0.5, 0), 0),
    # furniture without doubt, of all lengths
    ((6, 1.0, 0, 0.0, 5, 1.0, 0, 1, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), 0), ((2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0), 0), ((30, 0.1, 60, 0.0, 0, 0.0, 0, 1, 0), 0), ((12, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0), 0), ((25, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0), 0), ((60, 0.0, 50, 0.0, 12, 0.0, 1, 1, 0), 0), ((4, 0.0, 80, 0.0, 30, 0.0, 1, 1, 1), 0),
    ((3, 0.5, 40, 0.0, 3, 0.5, 1, 1, 0), 0), ((150, 0.0, 90, 0.0, 120, 0.0, 1, 1, 0), 0), ((90, 0.0, 10, 0.0, 50, 0.0, 0.5, 1, 0), 0), ((15, 0.0, 3, 1.0, 4, 1.0, 0.5, 1, 0), 0), ((2, 1.0, 2, 1.0, 2, 1.0, 0.5, 1, 0), 0), ((5, 0.0, 0, 0.0, 3, 1.0, 0.5, 1, 1), 0), ((200, 0.0, 60, 0.0, 60, 0.0, 0.5, 1, 0), 0), ((1, 0.0, 30, 0.0, 40, 0.0, 1, 1, 0), 0),
    # outside of the article of a page that has one
    ((9, 0.0, 4, 1.0, 8, 0.0, 0, 0, 0), 0), ((40, 0.0, 2, 0.0, 8, 0.0, 0, 0, 0), 0), ((14, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), 0), ((3, 1.0, 3, 1.0, 50, 0.0, 0, 0, 0), 0), ((5, 0.0, 3, 1.0, 6, 0.0, 0, 0, 1), 0), ((90, 0.0, 0, 0.0, 5, 0.0, 0, 0, 0), 0), ((120, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0), 0), ((9, 0.0, 2, 1.0, 8, 0.0, 0, 0.5, 0), 0), ((70, 0.0, 30, 0.0, 40, 0.0, 0, 0.5, 0), 0),
    # pages without an article element: paragraphs, headings and lists among running text
    ((60, 0.0, 8, 0.0, 45, 0.0, 0.5, 0, 0), 1), ((45, 0.1, 60, 0.0, 50, 0.0, 0.5, 0, 0), 1), ((25, 0.0, 45, 0.0, 3, 1.0, 0.5, 0, 0), 1), ((12, 0.0, 45, 0.0, 40, 0.0, 0.5, 0, 0), 1), ((7, 0.0, 2, 1.0, 60, 0.0, 0.5, 0, 1), 1), ((16, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 0), 1), ((7, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 0), 1),
    ((4, 0.0, 30, 0.0, 25, 0.0, 0.5, 0, 0), 1), ((6, 0.0, 40, 0.0, 0, 0.0, 0.5, 0, 0), 1), ((35, 0.0, 6, 1.0, 20, 0.0, 0.5, 0, 0), 1), ((18, 0.0, 1, 1.0, 18, 0.0, 0.5, 0, 0), 1),
    # and their menus, link lists and stray labels
    ((3, 1.0, 3, 1.0, 3, 1.0, 0.5, 0, 0), 0), ((1, 1.0, 0, 0.0, 2, 1.0, 0.5, 0, 0), 0), ((8, 0.9, 40, 0.0, 3, 1.0, 0.5, 0, 0), 0), ((20, 0.8, 4, 1.0, 5, 1.0, 0.5, 0, 0), 0), ((3, 0.0, 2, 1.0, 2, 1.0, 0.5, 0, 0), 0), ((2, 0.0, 0, 0.0, 3, 1.0, 0.5, 0, 0), 0), ((1, 1.0, 1, 1.0, 18, 0.0, 0.5, 0, 0), 0),
    ((2, 1.0, 3, 1.0, 60, 0.0, 0.5, 0, 0), 0), ((4, 1.0, 60, 0.0, 40, 0.0, 0.5, 0, 0), 0), ((3, 0.9, 0, 0.0, 30, 0.0, 0.5, 0, 0), 0), ((12, 1.0, 5, 0.0, 9, 0.0, 0.5, 0, 0), 0),
    ((1, 1.0, 0, 0.0, 1, 1.0, 0.5, 0, 0), 0), ((5, 1.0, 0, 0.0, 5, 1.0, 0.5, 0, 0), 0), ((9, 1.0, 30, 0.0, 0, 0.0, 0.5, 0, 0), 0), ((1, 1.0, 1, 0.0, 1, 0.0, 0.5, 0, 0), 0), ((2, 1.0, 0, 0.0, 40, 0.0, 0.5, 0, 0), 0), ((1, 1.0, 0, 0.0, 0, 0.0, 0.5, 0, 0), 0),
    # hints there: long running text outweighs a name
    ((60, 0.0, 70, 0.0, 80, 0.0, 0.5, 0.5, 0), 1), ((45, 0.0, 8, 0.0, 90, 0.0, 0.5, 0.5, 0), 1), ((100, 0.1, 60, 0.0, 0, 0.0, 0.5, 0.5, 0), 1), ((20, 0.0, 60, 0.0, 3, 1.0, 0.5, 0.5, 0), 0), ((9, 0.0, 2, 1.0, 60, 0.0, 0.5, 0.5, 0), 0), ((12, 0.0, 70, 0.0, 0, 0.0, 0.5, 0.5, 0), 0), ((5, 1.0, 3, 1.0, 4, 1.0, 0.5, 0.5, 0), 0), ((45, 0.8, 20, 0.9, 30, 0.7, 0.5, 0.5, 0), 0),
)
#: List items: runs of links at an article's end or start (further reading, tags, tables of contents), and lists that are text.
LISTED = (
    ((5, 1.0, 6, 1.0, 5, 1.0, 1, 0, 0), 0), ((7, 1.0, 70, 0.0, 6, 1.0, 1, 0, 0), 0), ((3, 1.0, 4, 1.0, 60, 0.0, 1, 0, 0), 0), ((6, 0.9, 5, 1.0, 0, 0.0, 1, 0, 0), 0), ((1, 1.0, 2, 1.0, 1, 1.0, 1, 0, 0), 0), ((12, 1.0, 11, 1.0, 9, 1.0, 1, 0, 0), 0), ((4, 1.0, 9, 0.0, 5, 1.0, 1, 0, 0), 0), ((2, 1.0, 3, 0.9, 8, 0.0, 1, 0, 0), 0),
    ((6, 0.0, 40, 0.0, 5, 0.0, 1, 0, 0), 1), ((3, 0.0, 4, 0.0, 2, 0.0, 1, 0, 0), 1), ((1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0), 1), ((12, 0.3, 9, 0.0, 10, 0.2, 1, 0, 0), 1), ((40, 0.1, 30, 0.0, 60, 0.0, 1, 0, 0), 1), ((1, 1.0, 60, 0.0, 50, 0.0, 1, 0, 0), 1), ((5, 0.0, 6, 0.0, 60, 0.0, 0.5, 0, 0), 1), ((9, 0.1, 30, 0.0, 8, 0.0, 0.5, 0, 0), 1),
    ((1, 1.0, 1, 1.0, 1, 1.0, 0.5, 0, 0), 0), ((3, 1.0, 0, 0.0, 2, 1.0, 0.5, 0, 0), 0), ((2, 1.0, 3, 1.0, 60, 0.0, 0.5, 0, 0), 0), ((4, 1.0, 70, 0.0, 5, 1.0, 0.5, 0, 0), 0), ((2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((8, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0), 0), ((3, 1.0, 2, 1.0, 2, 1.0, 1, 1, 0), 0), ((9, 0.0, 4, 0.0, 7, 0.0, 1, 1, 0), 0), ((5, 1.0, 4, 1.0, 6, 1.0, 1, 0.5, 0), 0), ((9, 0.0, 60, 0.0, 8, 0.0, 1, 0.5, 0), 0),
)
TABLE = (*(((*x, 0), y) for x, y in WRITTEN), *(((*x, 0), y) for _, _, x, y in PAGES), *(((*x, 1), y) for x, y in LISTED))


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: Sequence[tuple[Sequence[float], int]]):
        good = sum(y for _, y in rows)
        self.split, self.keep = None, 2 * good >= len(rows)
        if good in (0, len(rows)):
            return
        best = None
        for f in range(len(rows[0][0])):
            values = sorted({x[f] for x, _ in rows})
            for lo, hi in zip(values, values[1:], strict=False):
                cut = (lo + hi) / 2
                left, right = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
                cost = sum(len(s) * (p := sum(y for _, y in s) / len(s)) * (1 - p) for s in (left, right))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, cut, left, right
        if best:
            self.split = best[1], best[2], Tree(best[3]), Tree(best[4])

    def __call__(self, x: Sequence[float]) -> bool:
        node = self
        while node.split:
            f, cut, low, high = node.split
            node = low if x[f] <= cut else high
        return node.keep


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def furniture_of(tag: str, raw: str, in_article: bool) -> float:
    """1 for page furniture and reader comments, 0.5 for a hint at it, else 0."""
    if tag in ("html", "body"):
        return 0
    if tag in FURNITURE_TAGS:
        return 0 if tag == "header" and in_article else 1
    hint = 0.5 if tag in ("form", "fieldset") else 0
    if not raw.strip():
        return hint
    a = attributes(raw)
    names = set(TOKENS.split(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    comments = names & COMMENT_NAMES or any(COMMENT_PART.search(n) for n in names)
    advert = any(ADVERT_PART.search(n) for n in names) or any(ADVERT_ATTRIBUTE.search(k) for k in a)
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if hidden or a.get("role", "").lower() in FURNITURE_ROLES or comments and not (tag == "article" and "has" in names):
        return 1
    return 0.5 if names & FURNITURE_NAMES or advert or "header" in names and not in_article else hint


class Page:
    """Flat blocks of one page: text, words, words in links, in article, furniture, heading.

    Open elements are counted by name and by kind, so that a tag costs the same however many are open.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, bool, float, bool, bool]] = []
        self.stack: list[tuple[str, float, bool, int]] = []  # tag, furniture, article, hints that an article has set aside
        self.open_tags: Counter[str] = Counter()
        self.foreign: list[str] = []  # open svg, math and what may hold HTML inside of them
        self.sure, self.hints, self.articles = 0, 0, 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.links, self.silent, self.heading, self.item = 0, 0, False, False
        self.has_article = False
        at = 0
        while True:
            m = MARKUP.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            self.open(tag, m[3] or "")
        self.cut()

    def push(self, tag: str, furniture: float, article: bool) -> None:
        aside = 0
        if article and furniture < 1:
            aside, self.hints = self.hints, 0
        self.stack.append((tag, furniture, article, aside))
        self.open_tags[tag] += 1
        self.sure += furniture == 1
        self.hints += furniture == 0.5
        self.articles += article
        self.silent += tag in SILENT
        if tag in FOREIGN or tag in FOREIGN_HOLDERS:
            self.foreign.append(tag)

    def pop(self) -> str:
        tag, furniture, article, aside = self.stack.pop()
        self.open_tags[tag] -= 1
        self.sure -= furniture == 1
        self.hints += aside - (furniture == 0.5)
        self.articles -= article
        self.silent -= tag in SILENT
        if tag in FOREIGN or tag in FOREIGN_HOLDERS:
            self.foreign.pop()
        return tag

    def end_implied(self, tag: str) -> None:
        """Closes silent elements that a start tag, or text (no tag), ends without an end tag of theirs."""
        if tag == "body" and self.open_tags["head"] or tag not in IN_HEAD and self.stack[-1][0] == "head":
            self.close("head")
        if tag in BREAKOUT and self.silent and self.foreign and self.foreign[-1] in FOREIGN:
            self.close(self.foreign[-1])

    def text(self, raw: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and raw.strip():
            self.end_implied("")
        if raw and not self.silent:
            self.parts.append(raw)
            if self.links:
                self.linked.append(raw)

    def open(self, tag: str, raw: str) -> None:
        if self.silent:
            self.end_implied(tag)
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag not in INLINE:
                self.cut()
            return
        if tag == "a":
            self.links += 1
        if tag in SILENT:
            if SELF_CLOSED.search(raw):
                return
            self.push(tag, 0, False)
            return
        furniture = furniture_of(tag, raw, self.articles > 0)
        if tag in INLINE and not furniture:
            return
        self.cut()
        article = tag in ("article", "main")
        if article and furniture < 1:  # an unclosed menu does not swallow the article
            while self.stack and self.stack[-1][0] in ("nav", "ul", "ol", "header"):
                self.pop()
            self.has_article |= not self.sure
        if tag in OPEN_HEADINGS:
            self.heading = True
        if tag in ("li", "ul", "ol"):
            self.item = tag == "li"
        if tag not in ("p", "li", "dt", "dd", "tr", "td", "th") or furniture:
            self.push(tag, furniture, article)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in INLINE:
            self.cut()
        if tag in OPEN_HEADINGS:
            self.heading = False
        if tag in ("li", "ul", "ol"):
            self.item = False
        if self.open_tags[tag]:
            if tag in INLINE:
                self.cut()
            while self.pop() != tag:
                pass

    def cut(self) -> None:
        if self.parts:
            text = clean("".join(self.parts))
            if text:
                linked = len(clean(" ".join(self.linked)).split()) if self.linked else 0
                self.blocks.append((text, len(text.split()), linked, self.articles > 0, 1.0 if self.sure else 0.5 if self.hints else 0.0, self.heading, self.item))
            self.parts, self.linked = [], []

    def features(self) -> list[tuple[float, ...]]:
        flat = [(n, min(1.0, links / n)) for _, n, links, *_ in self.blocks]
        out = []
        for i, (_, _, _, article, furniture, heading, item) in enumerate(self.blocks):
            before, after = flat[i - 1] if i else (0, 0.0), flat[i + 1] if i + 1 < len(flat) else (0, 0.0)
            out.append((*flat[i], *before, *after, float(article) if self.has_article else 0.5, float(furniture), float(heading), float(item)))
        return out


def clean(raw: str) -> str:
    return WHITE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()


def extract(source: str | None, tree: Tree) -> str:
    if not source:
        return ""
    page = Page(source)
    return "\n\n".join(b[0] for b, x in zip(page.blocks, page.features(), strict=True) if tree(x))


def apply(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    bounded(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(TABLE)
        for batch in batches:
            texts = pa.array([extract(x.as_py(), tree) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])
        tidy()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(main_text, f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
