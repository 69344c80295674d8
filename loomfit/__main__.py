"""python -m loomfit rank PATH [--bound relaxed|conservative|aggressive|N] [--score aic|bic]

Ranks families of basis functions for the points of a CSV or JSON file.
"""

from __future__ import annotations

import argparse
import sys

from .operators.ranking import rank_bases
from .session import local_session
from .sources import points_csv, points_json


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="loomfit")
    sub = p.add_subparsers(dest="command", required=True)
    rank = sub.add_parser("rank")
    rank.add_argument("path")
    rank.add_argument("--bound", default="relaxed")
    rank.add_argument("--score", default="aic", choices=("aic", "bic"))
    a = p.parse_args(args)
    bound = int(a.bound) if a.bound.isdigit() else a.bound
    spark = local_session(4)
    pts = (points_json if a.path.endswith(".json") else points_csv)(spark, a.path)
    rows = rank_bases(pts, "x", "y", bound=bound, score=a.score).drop("model").collect()
    if not rows:
        print("no family could be fitted", file=sys.stderr)
        return 1
    for r in rows:
        print(f"{r['rank']}. {r['basis']:<12} {r['parameters']:>2} parameters  score {r['score']:.2f}  weight {r['weight']:.1%}  R2 {r['r_squared']:.4f}  normal {r['normality']:.3f}  rating {r['rating']:.0%}  {r['stars']:.1f} of 5")
        print(f"   {r['equation']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
