"""Queries over the driver tables, one or more for each operator, with the SQL that gives the same rows."""

from sievecraft.queries import asking, checking, deduced, documents, evaluation, evidence_windows, files, holding, more, ordered, outlines, records, secret, staged, state, stored, streams, weighing

QUERIES = {**documents.QUERIES, **evaluation.QUERIES, **records.QUERIES, **state.QUERIES, **more.QUERIES, **asking.QUERIES, **holding.QUERIES, **files.QUERIES, **weighing.QUERIES, **staged.QUERIES, **checking.QUERIES, **secret.QUERIES, **evidence_windows.QUERIES, **deduced.QUERIES, **outlines.QUERIES, **streams.QUERIES, **stored.QUERIES, **ordered.QUERIES}
ORACLE_SQL = {**documents.SQL, **evaluation.SQL, **records.SQL, **state.SQL, **more.SQL, **asking.SQL, **holding.SQL, **files.SQL, **weighing.SQL, **staged.SQL, **checking.SQL, **secret.SQL, **evidence_windows.SQL, **deduced.SQL, **outlines.SQL, **streams.SQL, **stored.SQL, **ordered.SQL}
