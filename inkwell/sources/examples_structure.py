"""Marked examples of the structure rules."""

EXAMPLES: dict[str, list[str]] = {
    "md/heading-increment": ["# One\n\n⟦### Three⟧\n", "# One\n\n## Two\n\n### Three\n\n# Four\n", "## Two\n\n⟦#### Four⟧\n\n##### Five\n"],
    "md/heading-style": ["# One\n\n⟦Two\n---⟧\n", "One\n===\n\n⟦## Two⟧\n\n### Three\n", "# One\n\n## Two\n"],
    "md/list-marker": ["* one\n* two\n\ntext\n\n⟦-⟧ three\n", "- one\n- two\n", "+ one\n\nword\n\n⟦*⟧ two\n"],
    "md/list-indent": ["* one\n ⟦*⟧ two\n* three\n", "* one\n  * two\n* three\n\nx\n\n* four\n    ⟦*⟧ five\n", "* one\n* two\n  * three\n"],
    "md/no-trailing-spaces": ["one⟦ ⟧\ntwo  \nthree\n", "one⟦\t⟧\n", "one\ntwo  \nthree\n\n```\ncode \n```\n"],
    "md/no-hard-tabs": ["one⟦\t⟧two\tthree\n", "```\n\tcode\n```\n"],
    "md/no-multiple-blanks": ["one\n\n⟦\n⟧\ntwo\n".replace("⟦\n⟧\n", "⟦⟧\n"), "one\n\ntwo\n", "one\n\n⟦\n⟧\nthree\n"],
    "md/line-length": ["w" * 100 + " " + "x" * 19 + "⟦ and more⟧\n", "w" * 160 + "\n", "short\n"],
    "md/blanks-around-headings": ["text\n⟦# One⟧\n\nmore\n", "# One\n\ntext\n", "⟦# One⟧\ntext\n"],
    "md/heading-start-left": ["⟦ ⟧# One\n", "# One\n", "⟦   ⟧## Two\n"],
    "md/no-duplicate-heading": ["# A\n\n## B\n\n⟦## B⟧\n", "# A\n\n## B\n\n# C\n\n## B\n", "# A\n\n## B  c\n\n⟦## B c⟧\n"],
    "md/single-h1": ["# A\n\n⟦# B⟧\n", "# A\n\n## B\n", "---\ntitle: T\n---\n\n⟦# A⟧\n"],
    "md/no-trailing-punctuation": ["⟦# One.⟧\n", "# One?\n", "⟦## Two:⟧\n"],
    "md/ol-prefix": ["1. a\n2. b\n⟦4.⟧ c\n", "1. a\n1. b\n1. c\n", "3. a\n4. b\n", "0. a\n0. b\n⟦1.⟧ c\n"],
    "md/blanks-around-fences": ["text\n⟦```sh⟧\nls\n```\n\nmore\n", "text\n\n```sh\nls\n```\n", "```sh\nls\n⟦```⟧\nmore\n"],
    "md/blanks-around-lists": ["text\n⟦- one⟧\n- two\n", "text\n\n- one\n- two\n\nmore\n", "- one\n⟦- two⟧\n# Head\n"],
    "md/no-bare-urls": ["See ⟦https://example.com/a⟧ now.\n", "See <https://example.com/a> and [x](https://example.com).\n", "`https://example.com`\n"],
    "md/no-emphasis-as-heading": ["⟦**Title here**⟧\n\ntext\n", "**Title here.**\n\ntext\n", "text\n\n⟦_Another_⟧\n\nmore\n", "**a** b\n"],
    "md/no-space-in-code": ["Use ⟦` ls`⟧ now.\n", "Use `ls` now.\n", "Use `` `x `` now.\n"],
    "md/fenced-code-language": ["⟦```⟧\nls\n```\n", "```sh\nls\n```\n", "⟦~~~~⟧\nls\n~~~~\n"],
    "md/first-line-heading": ["⟦text⟧\n", "# Head\n", "<!-- note -->\n\n# Head\n", "⟦## Two⟧\n"],
    "md/no-empty-links": ["⟦[a]()⟧ b\n", "[a](b)\n", "⟦[a](#)⟧\n"],
    "md/code-language-known": ["```⟦pyhton⟧\nx = 1\n```\n", "```python\nx = 1\n```\n", "```⟦zzzzzz⟧\n```\n"],
    "md/code-block-style": ["text\n\n⟦    code here⟧\n\nmore\n", "```sh\nls\n```\n"],
    "md/single-trailing-newline": ["text⟦⟧", "text\n", "text⟦\n\n⟧"],
    "md/heading-case": ["⟦# The Big House⟧\n", "# The big house\n", "# The API v2 of GitHub\n"],
    "md/image-alt": ["⟦![](a.png)⟧\n", "![a dog](a.png)\n", 'text ⟦<img src="a.png">⟧ here\n', 'text <img src="a.png" alt="x"> here\n'],
    "md/no-reversed-links": ["See ⟦(text)[url]⟧ here.\n", "See [text](url) here.\n", "See (text)[ref] here.\n\n[ref]: x\n"],
    "md/commands-show-output": ["⟦```sh\n$ ls\n$ pwd\n```⟧\n", "```sh\n$ ls\na b\n```\n"],
    "md/no-missing-space-atx": ["⟦#⟧Title\n", "# Title\n", "#123 is fixed\n", "⟦##⟧Two\n"],
    "md/no-multiple-space-atx": ["#⟦  ⟧Title\n", "# Title\n", "# Title⟦  ⟧#\n"],
    "md/no-missing-space-closed-atx": ["# Title⟦#⟧\n", "# Title #\n", "# About C#\n", "## Two⟦##⟧\n"],
    "md/no-multiple-space-blockquote": [">⟦  ⟧text\n", "> text\n", ">⟦   ⟧three\n"],
    "md/no-blanks-blockquote": ["> a\n⟦⟧\n> b\n", "> a\n>\n> b\n", "> a\n\ntext\n\n> b\n"],
    "md/list-marker-space": ["-⟦  ⟧one\n-⟦  ⟧two\n", "- one\n- two\n", "1. one\n2.⟦   ⟧two\n"],
    "md/hr-style": ["a\n\n---\n\nb\n\n⟦***⟧\n\nc\n", "a\n\n***\n\nb\n\n***\n"],
    "md/no-space-in-emphasis": ["some ⟦** bold**⟧ text\n", "some **bold** text\n", "a * b and c * d\n".replace("a * b and c * d", "2 + 3"), "some ⟦*word *⟧ text\n"],
    "md/no-space-in-links": ["see [⟦ text ⟧](url) here\n", "see [text](url) here\n"],
    "md/code-fence-style": ["```sh\nls\n```\n\n⟦~~~⟧sh\nls\n~~~\n", "```sh\nls\n```\n\n```sh\nls\n```\n"],
    "md/emphasis-style": ["*one* and ⟦_two_⟧ here\n", "_one_ and _two_ here\n"],
    "md/strong-style": ["**one** and ⟦__two__⟧ here\n", "**one** and **two** here\n"],
    "md/table-pipe-style": ["| a | b |\n| - | - |\n⟦1 | 2⟧\n", "| a | b |\n| - | - |\n| 1 | 2 |\n"],
    "md/table-column-count": ["| a | b |\n| - | - |\n⟦| 1 | 2 | 3 |⟧\n", "| a | b |\n| - | - |\n| 1 | 2 \\| x |\n"],
    "md/blanks-around-tables": ["text\n\n| a | b |\n| - | - |\n⟦| 1 | 2 |⟧\n# Head\n".replace("⟦| 1 | 2 |⟧\n# Head", "| 1 | 2 |\n\nmore"), "# Head\n⟦| a | b |⟧\n| - | - |\n| 1 | 2 |\n"],
    "md/descriptive-link-text": ["⟦[click here](a)⟧ now\n", "[the manual](a) now\n", "⟦[Read more:](a)⟧\n"],
    "md/no-duplicate-definition": ["[a][x]\n\n[x]: u\n⟦[x]: v⟧\n", "[a][x] [b][y]\n\n[x]: u\n[y]: v\n", "[//]: # (one)\n[//]: # (two)\n"],
    "md/no-empty-section": ["⟦# A⟧\n\n# B\n\ntext\n", "# A\n\n## B\n\ntext\n"],
    "md/alert-syntax": ["> [!⟦NOTTE⟧]\n> text\n", "> [!NOTE]\n> text\n", "> ⟦[!TIP] text⟧\n"],
    "md/no-heading-like-paragraph": ["⟦####### Seven⟧\n", "###### Six\n"],
    "md/max-heading-length": ["⟦# " + "word " * 13 + "end⟧\n", "# Short\n"],
    "md/no-inline-html": ["a ⟦<span>⟧b</span>\n", "a <kbd>b</kbd>\n"],
    "md/front-matter-required": ["⟦---⟧\nauthor: x\n---\n\ntext\n", "---\ntitle: x\n---\n\ntext\n", "⟦text⟧\n"],
    "md/task-list-style": ["- ⟦[X]⟧ done\n- [x] too\n", "- ⟦[]⟧ open\n", "- [ ] open\n"],
    "links/undefined-ref": ["see ⟦[text][nope]⟧\n", "see [text][yes]\n\n[yes]: u\n", "see ⟦[text][]⟧\n"],
    "links/unused-ref": ["text\n\n⟦[lonely]: u⟧\n", "[a][x]\n\n[x]: u\n", "[x] here\n\n[x]: u\n"],
    "links/undefined-footnote": ["text⟦[^1]⟧\n", "text[^1]\n\n[^1]: note\n", "`[^1]`\n"],
    "links/unused-footnote": ["text\n\n⟦[^a]:⟧ note\n", "text[^a]\n\n[^a]: note\n"],
    "links/duplicate-anchor": ["# One {#x}\n\n⟦# Two {#x}⟧\n", "# One {#x}\n\n# Two {#y}\n", "⟦# One {#two}⟧\n\n## Two\n"],
    "links/insecure": ["see ⟦[a](http://example.com)⟧\n", "see [a](https://example.com)\n", "see [a](http://localhost:80)\n", "[a][x]\n\n⟦[x]: http://example.com⟧\n"],
    "links/absolute-image-path": ["⟦![a](/img/a.png)⟧\n", "![a](img/a.png)\n", "⟦![a](C:/a.png)⟧\n", "![a](//host/a.png)\n"],
    "docs/toc-sync": [
        "<!-- toc -->\n- [A](#a)\n- [B](#b)\n<!-- tocstop -->\n\n## A\n\n## B\n", "<!-- toc -->\n- [A](#a)\n- ⟦[Old](#old)⟧\n<!-- tocstop -->\n\n## A\n", "⟦<!-- toc -->⟧\n- [A](#a)\n<!-- tocstop -->\n\n## A\n\n## B\n\n### C\n",
        "<!-- toc -->\n- [B](#b)\n- ⟦[A](#a)⟧\n<!-- tocstop -->\n\n## A\n\n## B\n",
    ],
    "md/front-matter-lang": ["⟦Det är en bok som jag har och den är inte ny.⟧\n", "It is a book that I have and it is not new at all.\n", "---\nlang: sv\n---\n\nDet är en bok som jag har och den är inte ny.\n"],
}
