"""The hashed draws of functions.hashing as a program of the executors' JVM, which turns its loops into vector instructions: several times as fast as arrays.

Spark's own compiler (Janino) makes it; executors get it as a jar of the application, once for each."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .hashing import _K, _START, _TURNS, _WORD

LANES = 1024
_BITS = ("({d} ^ ({b} & ({c} ^ {d})))", "({c} ^ ({d} & ({b} ^ {c})))", "({b} ^ {c} ^ {d})", "({c} ^ ({b} | ~{d}))")
_MAIN = """
  static void draws(int[] head, int[][] w, int[] a, int[] b, int[] c, int[] d) {
    java.util.Arrays.fill(a, START[0]); java.util.Arrays.fill(b, START[1]); java.util.Arrays.fill(c, START[2]); java.util.Arrays.fill(d, START[3]);
    for (int i = 0; i < 60; i += 2) {
      int[] y = w[WORD[i]], z = w[WORD[i + 1]];
      int k = K[i] + head[WORD[i]], l = K[i + 1] + head[WORD[i + 1]];
      if (i < 16) two0(a, b, c, d, y, z, k, TURNS[i], l, TURNS[i + 1]);
      else if (i < 32) two1(a, b, c, d, y, z, k, TURNS[i], l, TURNS[i + 1]);
      else if (i < 48) two2(a, b, c, d, y, z, k, TURNS[i], l, TURNS[i + 1]);
      else two3(a, b, c, d, y, z, k, TURNS[i], l, TURNS[i + 1]);
      int[] first = a, second = b;
      a = c; b = d; c = first; d = second;
    }
    last(a, b, c, d, w[WORD[60]], K[60] + head[WORD[60]], TURNS[60]);  // the last three turns only move the first word on, which now is in the first array
  }

  /** ids: longs, ascending; limits: longs, of the rows part, part + parts, ... Gives (row, row, draw) where the draw is below the first row's limit. */
  public Object call(Object idBytes, Object partOf, Object partsOf, Object limitBytes, Object seedOf) {
    java.nio.LongBuffer ids = java.nio.ByteBuffer.wrap((byte[]) idBytes).order(java.nio.ByteOrder.LITTLE_ENDIAN).asLongBuffer();
    java.nio.LongBuffer limits = java.nio.ByteBuffer.wrap((byte[]) limitBytes).order(java.nio.ByteOrder.LITTLE_ENDIAN).asLongBuffer();
    int part = ((Integer) partOf).intValue(), parts = ((Integer) partsOf).intValue(), n = ids.limit(), found = 0;
    int[] size = new int[21];
    int[][] rows = new int[21][];
    for (int i = 0; i < n; i++) size[Long.toString(ids.get(i)).length()]++;
    for (int k = 0; k < 21; k++) { rows[k] = new int[size[k]]; size[k] = 0; }
    for (int i = 0; i < n; i++) { int k = Long.toString(ids.get(i)).length(); rows[k][size[k]++] = i; }
    int[][][][] bodies = new int[21][4][][];
    int[] a = new int[LANES], b = new int[LANES], c = new int[LANES], d = new int[LANES], hits = new int[3072];
    int[][] own = new int[16][LANES];
    for (int i = part; i < n; i += parts) {
      long limit = limits.get((i - part) / parts);
      int start = i + 1;
      while (start < n && ids.get(start) == ids.get(i)) start++;
      if (limit <= 0 || start == n) continue;
      String before = seedOf + ":" + ids.get(i) + ":";
      int whole = before.length() / 4, rest = before.length() % 4;
      for (int k = 1; k < 21; k++) {
        int first = java.util.Arrays.binarySearch(rows[k], start);
        first = first < 0 ? -first - 1 : first;
        if (first >= rows[k].length) continue;
        int wide = (rest + k + 4) / 4;
        if (bodies[k][rest] == null) {
          int[][] made = new int[wide][rows[k].length + LANES];
          for (int r = 0; r < rows[k].length; r++) {
            String text = Long.toString(ids.get(rows[k][r]));
            for (int p = 0; p <= k; p++) made[(rest + p) / 4][r] |= (p < k ? (int) text.charAt(p) : 128) << 8 * ((rest + p) % 4);
          }
          bodies[k][rest] = made;
        }
        int[] head = new int[16];
        for (int p = 0; p < before.length(); p++) head[p / 4] |= (int) before.charAt(p) << 8 * (p % 4);
        head[14] = 8 * (before.length() + k);
        int[][] w = new int[16][];
        for (int p = 0; p < wide; p++) w[whole + p] = own[p];
        for (int s = first; s < rows[k].length; s += LANES) {
          for (int p = 0; p < wide; p++) System.arraycopy(bodies[k][rest][p], s, own[p], 0, LANES);
          draws(head, w, a, b, c, d);
          int m = Math.min(LANES, rows[k].length - s);
          for (int j = 0; j < m; j++) {
            int u = Integer.reverseBytes(a[j] + START[0]);
            if ((u & 0xFFFFFFFFL) < limit) {
              if (3 * found + 3 > hits.length) { int[] more = new int[2 * hits.length]; System.arraycopy(hits, 0, more, 0, hits.length); hits = more; }
              hits[3 * found] = i; hits[3 * found + 1] = rows[k][s + j]; hits[3 * found + 2] = u; found++;
            }
          }
        }
      }
    }
    java.nio.ByteBuffer out = java.nio.ByteBuffer.allocate(12 * found).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    for (int j = 0; j < 3 * found; j++) out.putInt(hits[j]);
    return out.array();
  }
}
"""


def _two(name: str, bits: str, y: str, z: str) -> str:
    """A loop that makes two turns; y, z: what of the block's words goes in."""
    one, other = bits.format(b="p", c="q", d="d[j]"), bits.format(b="e", c="p", d="q")
    loop = f"int p = b[j], q = c[j], x = a[j] + {one} + k{y}, e = p + ((x << s) | (x >>> (32 - s))); a[j] = e; x = d[j] + {other} + l{z}; d[j] = e + ((x << t) | (x >>> (32 - t)));"
    return f"  static void {name}(int[] a, int[] b, int[] c, int[] d, int[] y, int[] z, int k, int s, int l, int t) {{ for (int j = 0; j < LANES; j++) {{ {loop} }} }}\n"


def _source() -> str:
    turns = f"  static void last(int[] a, int[] b, int[] c, int[] d, int[] y, int k, int s) {{ for (int j = 0; j < LANES; j++) {{ int x = a[j] + {_BITS[3].format(b='b[j]', c='c[j]', d='d[j]')} + k + (y == null ? 0 : y[j]); a[j] = b[j] + ((x << s) | (x >>> (32 - s))); }} }}\n"
    for r, bits in enumerate(_BITS):
        turns += "".join(_two(f"two{r}{len(y) // 7}{len(z) // 7}", bits, y, z) for y in ("", " + y[j]") for z in ("", " + z[j]"))
        own = "(a, b, c, d, y, z, k, s, l, t);"
        turns += f"  static void two{r}(int[] a, int[] b, int[] c, int[] d, int[] y, int[] z, int k, int s, int l, int t) {{ if (y == null) {{ if (z == null) two{r}00{own} else two{r}01{own} }} else {{ if (z == null) two{r}10{own} else two{r}11{own} }} }}\n"
    table = lambda name, own: f"  static final int[] {name} = {{{', '.join(str(v - (1 << 32) if v >> 31 else v) for v in own)}}};\n"
    return f"public class WeftDraws implements org.apache.spark.sql.api.java.UDF5 {{\n  static final int LANES = {LANES};\n" + table("K", _K) + table("START", _START) + table("TURNS", _TURNS) + table("WORD", _WORD) + turns + _MAIN


_MADE: dict = {}


def _made(spark: SparkSession):
    """The program as a function of columns; its jar goes to the executors with the first use of an application."""
    name = spark.sparkContext.applicationId
    if name not in _MADE:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(_source())
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="weft-")), "weft-draws.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for kind, code in dict(compiler.getBytecodes()).items():
                jar.writestr(f"{kind}.class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        own = compiler.getClassLoader().loadClass("WeftDraws").newInstance()
        binary = jvm.org.apache.spark.sql.types.DataTypes.BinaryType
        _MADE.clear()
        _MADE[name] = jvm.org.apache.spark.sql.functions.udf(own, binary)
    return _MADE[name]


def drawn_below(spark: SparkSession, ids: str, part: str, parts: str, limits: str, seed: int) -> Column:
    """For columns of packed ids (ascending), part, parts and packed limits of the part's rows: (row, row, draw) as packed ints, where md5 of
    "seed:id:id" begins with 32 bits below the limit. The text must have 55 bytes at most."""
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    columns = [F.col(ids), F.col(part), F.col(parts), F.col(limits), F.lit(str(seed))]
    return Column(_made(spark).apply(_to_seq(spark.sparkContext, columns, _to_java_column)))
