"""Command line and request layer over stored indexes.

    python -m lexispark.app index corpus.tsv out [--positions]
    python -m lexispark.app search index [-k N] [--and | --phrase] [-t] words...
    python -m lexispark.app verify index
    python -m lexispark.app stats index
    python -m lexispark.app serve index [port]      (GET /search?q=&k=&op=, /stats, /health)

Exit codes: 0 done, 1 a file can't be read or isn't an index, 2 wrong use.
"""

from __future__ import annotations

import json
import sys
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .functions import tokenize_text
from .operators import Searcher, build_index
from .operators.search import NoPositionsError
from .plans import And, Or, Phrase, Term
from .sources import IndexFormatError, open_index, save_index, tsv_corpus
from .sources.store import size_in_bytes, verify


class Service:
    """Answers requests on one index folder.  A missing index is not an error until it is asked for."""

    def __init__(self, spark: SparkSession, path: str, max_k: int = 100, verify_first: bool = False):
        self.spark, self.path, self.max_k = spark, path, max_k
        self.index, self.problem = None, ""
        try:
            if verify_first:
                verify(spark, path)
            self.index = open_index(spark, path)
        except (OSError, IndexFormatError) as e:
            self.problem = f"index {path} is not available: {e}"

    def search(self, q: str, k: int = 10, op: str = "or") -> tuple[int, dict]:
        """(status, body); what is wrong is looked for in a fixed order."""
        if self.index is None:
            return 503, {"error": self.problem}
        if not 1 <= k <= self.max_k:
            return 400, {"error": f"k must be from 1 to {self.max_k}"}
        kinds = {"or": Or, "and": And, "phrase": Phrase}
        if (kind := op.lower()) not in kinds:
            return 400, {"error": f"unknown operator {op}; it is or, and, or phrase"}
        if kind == "phrase" and not self.index.has_positions:
            return 503, {"error": "the index has no positions, so it can't answer phrases"}
        terms = tokenize_text(self.spark, q)
        if not terms:
            return 400, {"error": "the query has nothing to search for"}
        query = Term(terms[0]) if len(terms) == 1 and kind != "phrase" else kinds[kind](*terms)
        found = Searcher(self.index).search(query, k)
        hits = [{"id": r.key, "score": r.score} for r in found.hits.collect()]
        return 200, {"query": q, "operator": kind, "totalHits": found.total, "totalHitsExact": found.exact, "returned": len(hits), "hits": hits}

    def stats(self) -> tuple[int, dict]:
        if self.index is None:
            return 503, {"error": self.problem}
        s = self.index.stats.first()
        return 200, {"documents": s.n_docs, "terms": s.n_terms, "tokens": s.total_tokens, "averageDocumentLength": s.avgdl, "fileBytes": size_in_bytes(self.spark, self.path)}

    def health(self) -> tuple[int, dict]:
        return (503, {"status": "down", "error": self.problem}) if self.index is None else (200, {"status": "up"})


def serve(service: Service, port: int = 8080, host: str = "127.0.0.1") -> HTTPServer:
    """A server of the service's answers as JSON; the caller runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            given = {name: values[-1] for name, values in parse_qs(url.query, keep_blank_values=True).items()}
            if url.path == "/search":
                k = given.get("k", "10")
                if "q" not in given:
                    status, body = 400, {"error": "q is missing"}
                elif not k.lstrip("-").isdigit():
                    status, body = 400, {"error": "k is not a number"}
                else:
                    status, body = service.search(given["q"], int(k), given.get("op", "or"))
            elif url.path in ("/stats", "/health"):
                status, body = getattr(service, url.path[1:])()
            else:
                status, body = 404, {"error": f"nothing at {url.path}"}
            text = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_) -> None:
            pass

    return HTTPServer((host, port), Handler)


def _index(spark: SparkSession, args: list[str]) -> str:
    positions = "--positions" in args
    rest = [a for a in args if a != "--positions"]
    if len(rest) != 2 or any(a.startswith("-") for a in rest):
        raise ValueError("index takes a corpus, a folder and perhaps --positions")
    save_index(build_index(tsv_corpus(spark, rest[0]), positions), rest[1])
    return f"indexed {open_index(spark, rest[1]).stats.first().n_docs} documents"


def _search(spark: SparkSession, args: list[str]) -> str:
    if not args:
        raise ValueError("search takes an index and words")
    path, *rest = args
    k, kinds, timed, words = 10, [], False, []
    while rest:
        a = rest.pop(0)
        if a == "-k":
            if not rest or not rest[0].lstrip("-").isdigit():
                raise ValueError("-k takes a number")
            k = int(rest.pop(0))
        elif a in ("--and", "--phrase"):
            kinds.append(a)
        elif a == "-t":
            timed = True
        elif a.startswith("-"):
            raise ValueError(f"unknown option {a}")
        else:
            words.append(a)
    if len({*kinds}) > 1:
        raise ValueError("--and and --phrase exclude each other")
    terms = [t[0] for w in words if (t := tokenize_text(spark, w))]  # of each word its first token
    if not terms:
        raise ValueError("nothing to search for")
    kind = Phrase if "--phrase" in kinds else And if kinds else Or
    query = Term(terms[0]) if len(terms) == 1 and kind is not Phrase else kind(*terms)
    began = time.perf_counter_ns()
    found = Searcher(open_index(spark, path)).search(query, k)
    lines = [f"hits{'=' if found.exact else '>='}{found.total}", *(f"{r.key}\t{r.score}" for r in found.hits.collect())]
    return "\n".join(lines + [f"elapsed_ns={time.perf_counter_ns() - began}"] * timed)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    try:
        if not args or args[0] not in ("index", "search", "verify", "stats", "serve"):
            raise ValueError(__doc__)
        spark = spark or SparkSession.builder.appName("lexispark").getOrCreate()
        command, *rest = args
        if command == "index":
            print(_index(spark, rest))
        elif command == "search":
            print(_search(spark, rest))
        elif command == "serve":
            if len(rest) not in (1, 2) or not all(port.isdigit() for port in rest[1:]):
                raise ValueError("serve takes an index and perhaps a port")
            serve(Service(spark, rest[0]), *map(int, rest[1:])).serve_forever()
        elif len(rest) != 1:
            raise ValueError(f"{command} takes an index")
        elif command == "verify":
            verify(spark, rest[0])
            print("ok")
        else:
            index = open_index(spark, rest[0])
            s = index.stats.first()
            print(f"documents={s.n_docs}\nterms={s.n_terms}\ntokens={s.total_tokens}\naverage_length={s.avgdl}\nbytes={size_in_bytes(spark, rest[0])}\npositions={index.has_positions}")
    except (ValueError, NoPositionsError) as e:
        print(e, file=sys.stderr)
        return 2
    except (OSError, IndexFormatError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
