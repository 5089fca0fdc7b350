import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakewarden.rules import RulePack  # noqa: E402
from lakewarden.session import local_session  # noqa: E402

CLIENTS = [
    ("C001", "Juan", "Perez", "12345678", "juan@email.com", "987654321", "Peru", "Retail"),
    ("C002", "Juan", "Perez", "12345678", "juan@email.com", "", "Perú", "Retail"),
    ("C003", "Maria", "Lopez", "999", "bad#mail", "", "PE", ""),
    ("C004", "Pedro", "Gomez", "87654321", "pedro@email.com", "912345678", "Chile", "Pyme"),
    ("C005", "Ana", "Diaz", "11223344", "", "999888777", "Peru", "Premium"),
]
SALES = [
    ("V001", "C001", "P001", "2024-01-10", 2, 100.0, 200.0, "Web"),
    ("V002", "C002", "P002", "2024-02-15", 0, 50.0, 0.0, "Tienda"),
    ("V003", "C999", "P003", "2024-03-20", 1, 200.0, 999.0, ""),
    ("V004", "C004", "P001", "2030-01-01", 3, 100.0, 300.0, "Web"),
]


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def pack():
    return RulePack()


@pytest.fixture(scope="session")
def clients(spark):
    return spark.createDataFrame(
        CLIENTS, "cliente_id nombre apellido dni correo telefono pais segmento".split()
    )


@pytest.fixture(scope="session")
def sales(spark):
    return spark.createDataFrame(
        SALES,
        "venta_id cliente_id producto_id fecha_venta cantidad precio_unitario total canal".split(),
    )
