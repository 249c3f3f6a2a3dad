"""The codec of the single bytes on the JVM (``codec.java``): the same streams as in Python, without rows leaving the executor.

Spark brings the compiler (Janino), and its jar goes to the executors once for each application. Where that can't be done, callers go on in Python.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexpack.functions import ans, stream

_made: dict[str, object] = {}


def _factory(sc):
    """The object that gives functions by name, made at the first call; None where it can't be."""
    if sc.applicationId not in _made:
        try:
            compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
            compiler.cook(pkgutil.get_data("lexpack.operators", "codec.java").decode())
            path = os.path.join(tempfile.mkdtemp(prefix="lexpack-"), "lexpack.jar")
            with zipfile.ZipFile(path, "w") as z:
                for name, code in dict(compiler.getBytecodes()).items():
                    z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
            sc._jsc.addJar(path)
            _made[sc.applicationId] = compiler.getClassLoader().loadClass("lexpack.Functions").newInstance()
        except Exception:  # no Janino, no classic session: Python does it
            _made[sc.applicationId] = None
    return _made[sc.applicationId]


def function(name: str, returns: str):
    """A function of columns by its class and the DDL of what it returns; None where there is none."""
    sc = SparkContext._active_spark_context
    if sc is None or ans.LOG != 16 or stream.LOG != 16 or (factory := _factory(sc)) is None:
        return None
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    f = factory.call(name, returns)

    def run(*columns) -> Column:
        own = [_to_java_column(F.col(c) if isinstance(c, str) else c) for c in columns]
        return Column(f.apply(_to_seq(sc, own)))

    return run


def either(python, name: str, returns: str, *options):
    """A function of a column: the JVM's with these options, else ``python``, which SQL registration takes too."""

    def run(column) -> Column:
        f = function(name, returns)
        return python(column) if f is None else f(column, *map(F.lit, options))

    run.python = python
    return run
