import pytest


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
