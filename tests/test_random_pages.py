"""Random pages whose expected text is made together with their HTML."""

import random

from conftest import wiki

from pageloom import articles, image_rows
from pageloom.profiles import WIKI


class Maker:
    """Each method gives (html, strings, shown): the markup, its strings, and what it shows where it is walked."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def text(self):
        word = self.rng.choice(["a", " b", "c ", " d e ", " ", "\n"])
        return word, [word.strip()] if word.strip() else [], word if word.strip() else ""

    def several(self, depth, limit=4):
        parts = []
        for _ in range(self.rng.randint(0, limit)):
            # Neighbouring strings would be one string.
            if parts and not parts[-1][0].endswith(">"):
                parts.append(("<!--c-->", [], ""))
            parts.append(self.node(depth))
        return "".join(p[0] for p in parts), [s for p in parts for s in p[1]], "".join(p[2] for p in parts)

    def node(self, depth, root=False):
        kinds = ["wrap", "p", "h", "ul", "ol", "dl", "br", "skip"] + ([] if root else ["text", "text", "text"])
        kind = self.rng.choice(kinds) if depth > 0 else self.rng.choice(["br", "empty"] + ([] if root else ["text"]))
        if kind == "text":
            return self.text()
        if kind == "br":
            return "<br>", [], "\n"
        if kind == "empty":
            return "<b></b>", [], ""
        if kind in ("ul", "ol"):
            return self.list(kind, depth)
        if kind == "dl":
            return self.definitions(depth)
        html, strings, shown = self.several(depth - 1)
        if kind == "wrap":
            return f"<div>{html}</div>", strings, shown
        if kind == "skip":
            tag = self.rng.choice(["sup", "table", 'i class="x reference"'])
            return f"<{tag}>{html}</{tag.split()[0]}>", strings, shown if root else ""
        if kind == "p":
            return f"<p>{html}</p>", strings, " ".join(strings) + "\n" if strings else ""
        level, name = self.rng.choice([1, 5, 6]), "".join(strings)
        excluded = " ".join(name.split()).lower() in WIKI.excluded_headings
        return f"<h{level}>{html}</h{level}>", strings, f"\n\n{'#' * level} {name}\n" if name and not excluded else ""

    def list(self, kind, depth):
        html, strings, items = "", [], []
        for _ in range(self.rng.randint(0, 4)):
            if self.rng.random() < 0.3:
                stray = self.node(depth - 1)
                html += stray[0] + "<!--c-->"
                strings += stray[1]
                if stray[0].startswith("<li"):
                    continue
            inner = self.several(depth - 1)
            html += f"<li>{inner[0]}</li>"
            strings += inner[1]
            items.append(inner[2].strip())
        marks = [f"{i + 1}. {t}\n" if kind == "ol" else f"* {t}\n" for i, t in enumerate(items) if t]
        return f"<{kind}>{html}</{kind}>", strings, "\n" + "".join(marks) + "\n" if marks else ""

    def definitions(self, depth):
        html, strings, lines = "", [], []
        for _ in range(self.rng.randint(0, 4)):
            inner = self.several(depth - 1)
            tag = self.rng.choice(["dt", "dd", "div"])
            html += f"<{tag}>{inner[0]}</{tag}>"
            strings += inner[1]
            name = " ".join(inner[1])
            if name and tag != "div":
                lines.append(f"**{name}**:\n" if tag == "dt" else f"  {name}\n")
        return f"<dl>{html}</dl>", strings, "\n" + "".join(lines) + "\n" if lines else ""


def test_text_of_random_pages(spark, pages):
    made = []
    for seed in range(500):
        maker = Maker(seed)
        made.append([maker.node(maker.rng.randint(1, 5), root=True) for _ in range(maker.rng.randint(0, 6))])
    htmls = [wiki("".join(p[0] for p in page)) for page in made]
    got = {r.page_id: r.content for r in articles(pages(*htmls)).collect()}
    wrong = {
        htmls[i]: (got[i], expected)
        for i, page in enumerate(made)
        if got[i] != (expected := " ".join("".join(p[2] for p in page).split()))
    }
    assert not wrong


def test_trailing_sections_among_random_siblings(spark, pages):
    rng = random.Random(3)
    lists = []
    for _ in range(300):
        siblings = []
        for i in range(rng.randint(0, 9)):
            level = rng.choice([1, 2, 3, 4, 5, 0, 0])
            siblings.append((level, f"notes {i}" if level and rng.random() < 0.4 else f"x{i}"))
        lists.append(siblings)
    htmls, expected = [], []
    for siblings in lists:
        gone = set()
        for i, (level, name) in enumerate(siblings):
            if level in (2, 3, 4) and "notes" in name:
                stop = next((j for j in range(i + 1, len(siblings)) if 0 < siblings[j][0] <= level), len(siblings))
                gone |= set(range(i, stop))
        htmls.append(wiki("".join(f"<h{n}>{t}</h{n}>" if n else f"<p>{t}</p>" for n, t in siblings)))
        left = [s for i, s in enumerate(siblings) if i not in gone]
        expected.append(" ".join(f"{'#' * n} {t}" if n else t for n, t in left))
    got = {r.page_id: r.content for r in articles(pages(*htmls)).collect()}
    assert [got[i] for i in range(len(htmls))] == expected


def test_image_owners_on_random_trees(spark, pages):
    """Containers are taken rule by rule, each with what is left below it."""
    classes = {1: "thumb", 2: "thumbimage", 3: "image", 4: "floatnone", 5: "floatright", 6: "floatleft"}
    rng = random.Random(8)

    def grow(depth):
        node = {"rule": rng.choice([None, *classes]), "below": [], "src": None, "alive": True}
        if depth == 0 or rng.random() < 0.3:
            node |= {"rule": None, "src": f"s{rng.randint(0, 10**6)}"}
        else:
            node["below"] = [grow(depth - 1) for _ in range(rng.randint(0, 3))]
        return node

    def html(node):
        if node["src"]:
            return f'<img src="{node["src"]}">'
        named = f' class="{classes[node["rule"]]}"' if node["rule"] else ""
        return f"<div{named}>{''.join(map(html, node['below']))}</div>"

    def walk(node):
        if node["alive"]:
            yield node
            for child in node["below"]:
                yield from walk(child)

    trees = [{"rule": None, "src": None, "alive": True, "below": [grow(5) for _ in range(3)]} for _ in range(300)]
    htmls = [wiki(html(t)) for t in trees]
    expected = {}
    for i, tree in enumerate(trees):
        found = []
        for rule in classes:
            for node in [n for n in walk(tree) if n["rule"] == rule]:
                if node["alive"]:
                    found += [n["src"] for n in walk(node) if n["src"]][:1]
                    for n in list(walk(node)):
                        n["alive"] = False
        expected[i] = found + [n["src"] for n in walk(tree) if n["src"]]
    got = {i: [] for i in expected}
    for r in image_rows(pages(*htmls)).orderBy("page_id", "ord").collect():
        got[r.page_id].append(r.src)
    assert got == expected
