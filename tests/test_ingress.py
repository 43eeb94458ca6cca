"""Rules of ingress on small programs."""

from factweave.sources import ingress

CLASSES = [("DATA", r"UART->DR|_DAT_40004404"), ("STATUS", r"UART->SR"), ("UNKNOWN_MMIO", r"_DAT_4[0-9a-f]{7}")]
PROGRAM = """
int uart_rx(uint8_t *dst, int n)
{
  uint8_t *p;
  p = (uint8_t *)dst + 4; /* = not one; */
  while (UART->SR == 0) { n = n - 1; }
  *p = UART->DR;
  local[n] = UART->SR;
  return n == 3;
}
void rx_ring(char *out) {
  out[0] = *(char *)(base + 0x10);
  shared_buf[1] = _DAT_40004404;
}
void handle_packet(struct pkt *msg, int len)
{
  char tmp[8];
  uart_rx(tmp, 8);
  uart_rx(0, 8);
  x = get_byte(3);
  get_byte(4);
  recv_data(&ctx, frame_buf, 12);
  recv_init(frame_buf);
  udp_input(frame_buf);
}
"""


def text(spark):
    df = spark.createDataFrame([(1, PROGRAM, "a"), (2, None, "b"), (3, "", "c"), (4, "int x = 3;", "d")], "id bigint, body string, line string")
    return ingress.Text(df, "id", "body")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_assignments(spark):
    got = rows(text(spark).assignments, "line", "lhs", "rhs", "writes", "base", "parameter")
    assert got == [
        (5, "p", "(uint8_t *)dst + 4", False, "p", -1), (6, "n", "n - 1", False, "n", 1), (7, "*p", "UART->DR", True, "dst", 0), (8, "local[n]", "UART->SR", True, "local", -1),
        (12, "out[0]", "*(char *)(base + 0x10)", True, "out", 0), (13, "shared_buf[1]", "_DAT_40004404", True, "shared_buf", -1), (20, "x", "get_byte(3)", False, "x", -1),
    ]


def test_registers_and_what_follows_from_bodies(spark):
    t = text(spark)
    assert rows(ingress.register_sources(t, CLASSES), "function", "buffer") == [("rx_ring", "shared_buf"), ("uart_rx", "dst")]
    s = ingress.body_summaries(t, CLASSES)
    assert rows(s, "callee", "parameter", "evidence_line") == [("uart_rx", 0, 7)]
    assert rows(ingress.body_derived_sources(t, s), "function", "callee", "buffer", "line") == [("handle_packet", "uart_rx", "tmp", 18)]
    assert rows(ingress.complex_bodies(t, CLASSES), "function", "buffer") == [("rx_ring", "out"), ("uart_rx", "dst")]


def test_registries(spark):
    t = text(spark)
    api = spark.createDataFrame([("recv_data", 1, 2, "L"), ("recv_init", 4, -1, "L")], "callee string, buffer_arg int, length_arg int, label string")
    assert rows(ingress.api_sources(t, api), "callee", "buffer", "length", "label") == [("recv_data", "frame_buf", "12", "L")]
    returns = spark.createDataFrame([("get_byte", "B")], "callee string, label string")
    assert rows(ingress.return_sources(t, returns), "line", "buffer", "site") == [(20, "x", "x = get_byte(3)"), (21, "get_byte()", "get_byte(4)")]
    framework = spark.createDataFrame([("handle_packet", 0, "F"), ("rx_ring", 3, "F")], "function string, buffer_param int, label string")
    assert [r[0] for r in rows(ingress.framework_sources(t, framework), "function")] == ["handle_packet"]


def test_candidates_by_name(spark):
    t = text(spark)
    assert rows(ingress.callsite_candidates(t, ["recv", "input"]), "callee", "buffer") == [("recv_data", "frame_buf")]
    assert rows(ingress.function_candidates(t, ["handle", "recv"]), "function", "buffer") == [("handle_packet", "struct pkt *msg")]


SINKS = """
void copy(char *dst, char *src, int n) {
  for (i = 0; i < n; i = i + 1) {
    dst[i] = src[i];
  }
  dst[n] = 0;
}
void fill(char *dst)
{
  while (1) *dst = _DAT_40001000;
  do { x = 1; } while (x);
}
void parse(struct s *out, uint8_t *data)
{
  int v;
  out->len = data[2] + 1;
  v = *(int *)(data + 4);
  out->size = v;
  out->zero = 0;
}
"""


def test_sinks(spark):
    from factweave.sources import egress

    df = spark.createDataFrame([(1, SINKS), (2, None), (3, "while (")], "id bigint, body string")
    t, loops = ingress.Text(df, "id", "body"), egress.scan_loops(df, "id", "body")
    assert rows(loops, "head", "line", "last_line") == [("do", 11, 11), ("for (i = 0; i < n; i = i + 1)", 3, 5), ("while (1)", 10, 10), ("while (x)", 11, 11)]
    assert rows(egress.loop_writes(t, loops), "function", "line", "places", "label") == [("copy", 4, 1, "COPY_SINK"), ("fill", 10, 1, "LOOP_WRITE_SINK")]
    assert rows(egress.parser_stores(t), "function", "line", "places") == [("parse", 16, 1)]
    assert rows(egress.field_updates(t), "function", "line", "site") == [("parse", 18, "out->size = v")]
