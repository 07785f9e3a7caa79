"""HTML extraction: elements that are skipped whole swallow nothing else."""

from stepfold.llm import wrappers


def test_what_follows_skipped_elements_stays():
    for html, want in {
        '<article><p>one <svg class="i"/> two</p><p>three</p></article>': "one two three",
        "<article><p>one <math/> two</p><svg><text>no</text></svg><p>three</p></article>": "one two three",
        "<article><title-bar>one</title-bar><object-card>two</object-card><p>three</p></article>": "one two three",
        "<article><p>one <svg> two</p><p>three</p><object data=x><p>four</p></article>": "one two three four",
        "<article><p>one</p><script>no<p>no</p></SCRIPT ><p>two</p><script>no</article>": "one two",
        "<article><p>one</p></svg><SVG a='/>'>no</svg><p>two</p><textarea>no": "one two",
    }.items():
        assert wrappers.main_text(html, None) == want
