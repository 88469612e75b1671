"""The small labelled tables the markup trees are fitted on.

LABELLED: (block text, kinds shown); PAGES: (blocks of a small page in order), each
(text, part of it inside links, kinds shown).  Kinds: h HTML, m Markdown, w wiki,
l LaTeX.  Written by hand; they hold as many texts that only look like markup as ones
that show it.  In PAGES the same forms are markup in running text and none in menus,
trails and lists of links, which only the blocks around them and their links tell.
"""

LABELLED = [
    ("<h2>Opening times</h2> the hall is open all day", "h"), ("<p>A first paragraph</p>", "h"), ("</div></div>", "h"), ("one line<br />another line", "h"), ("<br>", "h"),
    ('<span style="color:red">warning</span> do not enter', "h"), ("<!-- begin teaser -->", "h"), ("see <a href=\"/about\">the about page</a> for more", "h"), ("<b>bold claim</b>", "h"),
    ("<ul><li>first</li><li>second</li></ul>", "h"), ("<table><tr><td>a</td></tr></table>", "h"), ("<pre>x = 1</pre>", "h"), ("bread &amp; butter", "h"), ("one&nbsp;&nbsp;two", "h"),
    ("&quot;quoted&quot; words", "h"), ("it&#8217;s late", "h"), ("5 &lt; 6", "h"), ("a<br/>b", "h"), ("<em>so</em> it goes", "h"), ("<img src=\"x.png\"/>", "h"), ("caf&eacute;", "h"), ("&#x27;hi&#x27;", "h"),
    ("## A heading", "m"), ("### Another heading ###", "m"), ("# Title", "m"), ("it was **very** late", "m"), ("**bold**", "m"), ("__strong__ and *soft words here*", "m"), ("~~struck~~ out", "m"),
    ("![a picture](/img/a.jpg)", "m"), ("[a link](https://a.example/b)", "m"), ("[a link][3]\n\n[3]: https://a.example", "m"), ("```\nx = 1\nprint(x)\n```", "m"), ("- [ ] call back\n- [x] write", "m"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "m"), ("A title\n=====", "m"), ("Run `tool --all` first.", "m"), ("> quoted line", "m"), ("> quoted line\n> and another", "m"), ("1. first\n2. second", "m"), ("- first item\n- second item", "m"),
    ("* first item\n* second item", "m"), ("some text ## A heading in the middle", "m"), ("then *two soft words* follow", "m"), ("before | a | b |\n|---|---|\n| 1 | 2 | after", "m"), ("so - [ ] one thing\n- [ ] another", "m"), ("words > one quoted line > more", "m"),
    ("[[Main page]]", "w"), ("[[town|the town]] is small", "w"), ("[[File:a.jpg|thumb|A view]]", "w"), ("[[Category:towns]]", "w"), ("'''Bold name''' is a town", "w"), ("''soft'' name", "w"), ("== History ==", "w"),
    ("=== Early years ===", "w"), ("{{cite web|title=News|year=2001}}", "w"), ('{| class="wikitable"\n! a\n! b\n|-\n| 1 || 2\n|}', "w"), ("__TOC__", "w"), ("#REDIRECT [[Other page]]", "w"), ("I agree ~~~~", "w"), (":::I agree with this ~~~~", "w"),
    ('<ref name="a">News of the day</ref>', "w"), ("<ref>News of the day</ref>", "w"), ("[http://a.example a page about it]", "w"), ("* [[first]]\n* [[second]]", "w"), ("text == Section == text", "w"), ("|-\n| 1 || 2", "w"), ("{{Infobox|name=Town}}", "w"),
    ("\\section{Results}", "l"), ("\\subsection*{More}", "l"), ("\\emph{so} we see", "l"), ("\\textbf{bold}", "l"), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "l"), ("$$\\frac{a}{b}$$", "l"), ("\\[ y = \\alpha x \\]", "l"), ("see Section~\\ref{sec:a}", "l"),
    ("as shown before~\\cite{smith2001}", "l"), ("where $E_{3} = m v^2$ holds", "l"), ("a share of 12\\% \\& more", "l"), ("``quoted words''", "l"), ("and so on \\ldots", "l"), ("\\footnote{a note}", "l"), ("\\begin{equation} f(x) = x^{2} \\end{equation}", "l"),
    ("\\begin{verbatim}\nrun it\n\\end{verbatim}", "l"), ("``A quotation''~\\cite{a}", "l"), ("let $x_i$ be real", "l"), ("$\\alpha$", "l"),
    ("The price rose from $5 to $7 within 3 days.", ""), ("The label reads 3 < 5 and 9 > 4, which amused everyone.", ""), ("They play in C# and F# on old guitars [1].", ""), ("Group #1 met group #2 at the * bridge *.", ""), ("A note [sic] in the margin says Baker & sons.", ""),
    ("The file is called total_count_3.txt and lies in C:\\data\\reports.", ""), ("The score was 2-1 ~ about what we expected.", ""), ("Open curly brackets { like these } are drawn on the tiles.", ""), ("Write to office_3@town.example or use the form - it is short.", ""),
    ("The council repaired the broken clock - at last.", ""), ("A & B Ltd. paid 5 % more", ""), ("It was 5 * 3 = 15", ""), ("a plain sentence with nothing in it", ""), ("Anna’s ‘little’ house", ""), ("a_b and c_d are names", ""), ("(see Fig. 3) near the river", ""), ("«Bonjour», dit-elle.", ""),
    ("50 % — so they say", ""), ("the vote was 3/4 + 1/4 = 1", ""), ("he said: \"no\" & left", ""), ("{{ user.first_name }} writes", ""), ("{{#each items}}", ""), ("${city} at night", ""), ("#{name} was here", ""), ("__COMPANY__", ""), ("<%= place %>", ""), ("{% endblock %}", ""), ("%(count)d", ""), ("%%DATE%%", ""),
    ("{0}", ""), ("[INSERT NAME]", ""), ("[Your Name] is", ""), ("[[title]]", ""), ("It costs $5, $6 or $7.", ""), ("1. FC won", ""), ("- 5 degrees", ""), ("x > y", ""), ("a < b > c", ""), ("= 3 =", ""), ("Rock 'n' roll's \"best\"", ""), ("100 ~ 200 people", ""), ("C:\\new\\table", ""), ("[12] and [13]", ""), ("@home", ""), ("5 | 6 | 7", ""),
    ("You may also like: a story", ""), ("News · Sport · Weather", ""), ("Home › News › Today", ""), ("© 2024 The Daily. Privacy", ""), ("", ""),
]

P1 = "The council met on Monday and talked about the old bridge, which has been closed since spring."
P2 = "Nobody knows yet when the work will be done. The mayor said that it depends on the weather and on the money."
P3 = "A short note."
PAGES = [
    # trails: the signs of a quotation between links
    [("Home > News > Town > Today", 0.8, ""), (P1, 0.0, ""), (P2, 0.0, "")], [("Start > Sport > Results", 0.9, ""), (P2, 0.0, "")], [(P1, 0.0, ""), ("Shop > Books > Maps", 0.7, ""), (P3, 0.0, "")],
    [("Front page > Culture > Music", 0.75, ""), (P3, 0.0, ""), (P1, 0.0, "")], [("Archive > June > Letters", 1.0, ""), ("Older > Newer > All", 1.0, "")],
    [(P1, 0.0, ""), ("she wrote > that it was late > and left", 0.0, "m"), (P2, 0.0, "")], [(P2, 0.0, ""), ("then > one line of an answer > another line", 0.0, "m")], [("first > we never said that > so we answered", 0.0, "m"), (P1, 0.0, "")],
    [(P3, 0.0, ""), ("he said > not today > and went", 0.0, "m"), (P3, 0.0, "")], [(P1, 0.0, ""), ("> not before Monday", 0.0, "m"), (P2, 0.0, "")],
    # numbered and dashed lists of links
    [("1. Bridge closed\n2. Market moved\n3. School opens", 0.9, ""), (P1, 0.0, "")], [(P2, 0.0, ""), ("1. Read the paper\n2. Write to us", 0.8, ""), ("News Sport", 1.0, "")], [("- Imprint\n- Contact\n- Terms", 0.95, ""), ("About", 1.0, "")],
    [("* Weather\n* Culture\n* Sport", 0.9, ""), (P1, 0.0, "")], [(P1, 0.0, ""), ("- Older posts\n- Newer posts", 0.85, "")],
    [(P1, 0.0, ""), ("1. take the bus\n2. walk to the hall", 0.0, "m"), (P2, 0.0, "")], [(P2, 0.0, ""), ("- bread for all\n- a new map", 0.0, "m"), (P1, 0.0, "")], [(P3, 0.0, ""), ("* call the office\n* wait for an answer", 0.0, "m"), (P3, 0.0, "")],
    [("- two pounds of flour\n- one egg", 0.1, "m"), (P2, 0.0, "")], [(P1, 0.0, ""), ("1. open the door\n2. close it", 0.1, "m")],
    # rules and signs of menus
    [("News | Sport | Weather |--- | More", 0.8, ""), (P1, 0.0, "")], [("== Menu == Home Shop", 0.7, ""), (P2, 0.0, "")], [("# News # Sport # Weather", 0.9, ""), (P1, 0.0, "")], [(P2, 0.0, ""), ("# bridge # council # spring", 0.8, ""), (P3, 0.0, "")],
    [("# Opening times", 0.0, "m"), (P1, 0.0, ""), (P2, 0.0, "")], [(P1, 0.0, ""), ("## What comes next", 0.0, "m"), (P2, 0.0, "")], [(P3, 0.0, ""), ("== Early days ==", 0.0, "w"), (P1, 0.0, "")],
    [(P1, 0.0, ""), ("The hall was [[old town hall|rebuilt]] in spring.", 0.0, "w"), (P2, 0.0, "")], [(P1, 0.0, ""), (P2, 0.0, ""), ("&copy; &nbsp; the council", 0.0, "h")], [(P1, 0.0, ""), ("so \\emph{late} in the year", 0.0, "l"), (P2, 0.0, "")],
    # long blocks with one link and markup somewhere inside
    [(P1, 0.0, ""), (P1 + " == Early days == " + P2, 0.02, "w"), (P2, 0.1, "")], [(P2, 0.0, ""), (P2 + " === Later === " + P1, 0.05, "w")], [(P1 + " ## Later " + P2, 0.03, "m"), (P2, 0.0, "")], [(P1, 0.0, ""), (P2 + " he said > not today > and went " + P1, 0.04, "m")],
    [(P1 + "\n- one egg\n- two eggs\n" + P2, 0.06, "m"), (P1, 0.02, "")], [(P2, 0.0, ""), (P1 + "\n1. open it\n2. close it", 0.05, "m")],
    # labels of menus: a sign before a word, with links around it
    [("# Topics", 0.0, ""), ("Bridge Council Spring", 1.0, ""), ("More", 1.0, "")], [("Home News", 1.0, ""), ("# Sections", 0.0, ""), ("Sport Weather", 0.9, "")], [("== Menu ==", 0.0, ""), ("Home Shop Contact", 1.0, "")], [("Shop", 1.0, ""), ("== Service ==", 0.0, ""), ("Imprint Terms", 0.95, "")],
    [("# Topics", 0.0, "m"), (P1, 0.0, "")], [(P2, 0.0, ""), ("# Sections", 0.0, "m"), (P1, 0.1, "")], [(P1, 0.0, ""), ("== Service ==", 0.0, "w"), (P2, 0.05, "")], [("== History ==", 0.0, "w"), (P2, 0.0, "")],
]
