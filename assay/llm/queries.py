"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from assay.llm import licenses, mixing
from assay.llm.imatch import op6_fingerprints
from assay.llm.langid import op7_language_id
from assay.llm.licenses import op9_licenses
from assay.llm.media import op4_media
from assay.llm.mixing import op1_mixing
from assay.llm.packing import op8_packing
from assay.llm.pii import op2_pii
from assay.llm.sharding import op10_sharding
from assay.llm.simhash import op3_simhash
from assay.llm.warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_simhash, op4_media, op5_warc, op6_fingerprints, op7_language_id, op8_packing, op9_licenses, op10_sharding)}
SQL = {**mixing.SQL, **licenses.SQL}
