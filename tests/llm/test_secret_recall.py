"""What the character models find in held-out strings of each kind, and what they leave alone."""

import random
import string

from pyspark.sql import functions as F

from syndrift.llm import secret_scan

LETTERS, DIGITS = string.ascii_letters, string.digits
KINDS = {
    "mixed 16": (LETTERS + DIGITS, 16), "mixed 20": (LETTERS + DIGITS, 20), "mixed 32": (LETTERS + DIGITS, 32), "base 64": (LETTERS + DIGITS + "+/", 32), "for urls": (LETTERS + DIGITS + "-_", 32),
    "upper and digits": (string.ascii_uppercase + DIGITS, 20), "lower and digits": (string.ascii_lowercase + DIGITS, 20), "letters": (LETTERS, 20), "lower": (string.ascii_lowercase, 24), "upper": (string.ascii_uppercase, 32),
    "hex": (DIGITS + "abcdef", 32),
}
ORDINARY = """
550e8400-e29b-41d4-a716-446655440000 2021-03-04T12-30-15 images/2021/03/screenshot-2021-03-04 SHA256WithRSAEncryption2048 utf8mb4_unicode_520_ci abstractSingletonProxyFactoryBean2 plain_identifier_name_here theInternationalisation2 other/the/nation/in/there
user_profile_settings org/apache/commons/lang3/StringUtils java/util/concurrent/ThreadPoolExecutor 20210304123456789 1234567890123456 com_android_internal_R_styleable node_modules/react-dom/index wp-content/uploads/2019/07/IMG_20190704_123456 MAX_CONNECTION_TIMEOUT_MS getElementsByClassName x86_64-unknown-linux-gnu
application/x-www-form-urlencoded Content-Disposition  X-Requested-With-Header windows-1252-encoding ISO_8859_1_CHARSET  kubernetes-deployment-7 sha512-rsa-pkcs1-v1 AbstractQueuedSynchronizer  donaudampfschifffahrtsgesellschaft responsabilidades-internacionales anticonstitutionnellement
HTTPServletRequestWrapper XMLHttpRequestUpload addEventListener3  en/78/page-2/section-4  archive/2020/12/25/merry-christmas  IMG_20200101_000001  GL_TEXTURE_2D_MULTISAMPLE 00000000000000000000 ---------------------- ====================== ______________________ 1.2.3 release-2024-11-05-rc1
test_that_the_user_can_log_in  0x00000000FFFFFFFF  F47AC10B-58CC-4372-A567-0E02B2C3D479 6ba7b810-9dad-11d1-80b4-00c04fd430c8 python3-config-x86_64 linux-image-5-15-0-91-generic
""".split()


def test_recall_and_false_flags(spark):
    rng = random.Random(11)
    rows = [(k, "".join(rng.choice(chars) for _ in range(n))) for k, (chars, n) in KINDS.items() for _ in range(300)] + [("ordinary", t) for t in ORDINARY if len(t) >= 16]
    model = secret_scan.trained(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df = spark.createDataFrame([(i, f"see {t} there") for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id for r in secret_scan.scan(df, model).where(F.size("spans") > 0).select("doc_id").collect()}
    share = lambda k: sum(i in found for i, (kind, _) in enumerate(rows) if kind == k) / sum(kind == k for kind, _ in rows)
    assert {k: share(k) for k in KINDS if share(k) < 0.9} == {}
    assert share("ordinary") < 0.05
