"""The README's usage example runs end to end on a small press tree."""

import os
import re
import tempfile

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_example_runs(spark):
    code = re.search(r"## Using pressroom.*?```python\n(.*?)```", open(README, encoding="utf-8").read(), re.S).group(1)
    root = tempfile.mkdtemp(prefix="pressroom-usage-")
    os.makedirs(f"{root}/X")
    with open(f"{root}/X/2024-12-05_X_t.csv", "w", encoding="cp949") as f:
        f.write("user_nickname,comments,visible,regTime,sympathyCount,antipathyCount\n"
                'u,"good news, great",True,2024-12-05T10:00:00+0900,3,1\n'
                "v,bad,False,2024-12-06T22:00:00+0900,0,5\n")
    env: dict = {}
    exec(code.replace('"/data/news_comments"', repr(root)), env)  # noqa: S102 -- our own README
    assert env["per_press"].count() == 1 and env["hours"].count() == 24
    assert env["by_group"].count() == 2 and env["month_totals"].first().n_comments == 2
