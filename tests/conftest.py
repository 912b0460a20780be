import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from caseflow.session import get_session
    s = get_session("local[4]", 4, app_name="caseflow-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseflow-test-ckpt-"))
    yield s


def _log(spark, rows):
    from datetime import datetime
    schema = ("case_id string, activity string, timestamp timestamp_ntz, resource string, seq bigint, "
              "deadline timestamp_ntz, status string, group_code string, priority string, "
              "purpose_code string, intervention_type string, cost double")
    conv = []
    for r in rows:
        r = list(r)
        for i in (2, 5):
            r[i] = datetime.fromisoformat(r[i]) if r[i] else None
        conv.append(tuple(r) + (None,) * (12 - len(r)))
    return spark.createDataFrame(conv, schema)


# Two hand-typed sample logs (the 8-event samples of the reference), canonical names.
LOG2 = [
    ("C1", "Registrar Pedido", "2023-01-01 09:00:00", "João", 10, "2023-01-03 10:00:00", "REG", "P001", "Alta"),
    ("C1", "Aprovar Pedido", "2023-01-01 11:30:00", "Maria", 25, "2023-01-03 10:00:00", "APR", "P002", "Média"),
    ("C1", "Enviar Produto", "2023-01-04 09:00:00", "Carlos", 40, "2023-01-03 10:00:00", "ENV", "P003", "Baixa"),
    ("C1", "Faturar", "2023-01-05 09:00:00", "Ana", 55, "2023-01-03 10:00:00", "FAT", "P001", "Alta"),
    ("C2", "Registrar Pedido", "2023-01-01 10:30:00", "João", 5, "2023-01-01 16:45:00", "REG", "P002", "Alta"),
    ("C2", "Rejeitar Pedido", "2023-01-01 16:45:00", "Pedro", 30, "2023-01-01 16:45:00", "REJ", "P002", "Média"),
    ("C3", "Registrar Pedido", "2023-01-02 10:30:00", "João", 5, "2023-01-01 16:45:00", "REG", "P001", "Alta"),
    ("C3", "Rejeitar Pedido", "2023-01-03 16:45:00", "Pedro", 30, "2023-01-01 16:45:00", "REJ", "P002", "Média"),
]
LOG3 = [
    ("C1", "A", "2023-01-01 09:00:00", "João", 10, "2023-01-03 10:00:00", "A", "P001", "Alta", "COD001", "TIPO_A"),
    ("C1", "B", "2023-01-01 11:30:00", "Maria", 25, "2023-01-03 10:00:00", "B", "P002", "Média", "COD001", "TIPO_A"),
    ("C1", "C", "2023-01-04 09:00:00", "Carlos", 40, "2023-01-03 10:00:00", "C", "P003", "Baixa", "COD001", "TIPO_A"),
    ("C1", "D", "2023-01-05 09:00:00", "Ana", 55, "2023-01-03 10:00:00", "D", "P001", "Alta", "COD001", "TIPO_A"),
    ("C2", "A", "2023-01-01 10:30:00", "João", 5, "2023-01-01 16:45:00", "A", "P002", "Alta", "COD002", "TIPO_B"),
    ("C2", "E", "2023-01-01 16:45:00", "Pedro", 30, "2023-01-01 16:45:00", "E", "P002", "Média", "COD002", "TIPO_B"),
    ("C3", "A", "2023-01-02 10:30:00", "João", 5, "2023-01-01 16:45:00", "A", "P001", "Alta", "COD002", "TIPO_B"),
    ("C3", "D", "2023-01-03 10:30:00", "Pedro", 30, "2023-01-01 16:45:00", "D", "P002", "Média", "COD002", "TIPO_B"),
]


@pytest.fixture
def log2(spark):
    return _log(spark, LOG2)


@pytest.fixture
def log3(spark):
    return _log(spark, LOG3)


@pytest.fixture
def make_log(spark):
    return lambda rows: _log(spark, rows)
