from __future__ import annotations

import pytest

from tidelog import config
from tidelog.errors import ConfigError


def test_defaults_and_precedence(tmp_path):
    assert config.load({}, tmp_path).server.port == 21524
    (tmp_path / "config.toml").write_text(f'[storage]\ndata_dir = "{tmp_path}/a"\nmemtable_size_mb = 8\n[server]\nport = 80\n')
    named = tmp_path / "other.toml"
    named.write_text(f'[storage]\ndata_dir = "{tmp_path}/b"\n')
    assert config.load({}, tmp_path).storage.memtable_size_mb == 8
    assert config.load({"TIDELOG_CONFIG": str(named)}, tmp_path).storage.data_dir.endswith("/b")
    assert config.load({"TIDELOG__SERVER__PORT": "443"}, tmp_path).server.port == 443
    assert not (tmp_path / "a" / ".write_test").exists()


@pytest.mark.parametrize("text", ['[storage]\nmemtable_size_mb = "not_a_number"', "[storage", "storage = 1", "[server]\nport = true"])
def test_unreadable(tmp_path, text):
    (tmp_path / "config.toml").write_text(text)
    with pytest.raises(ConfigError):
        config.load({}, tmp_path)


def test_missing_named_file(tmp_path):
    for named in (str(tmp_path / "none.toml"), "", str(tmp_path)):  # a folder is there, but can't be read as a file
        with pytest.raises(ConfigError):
            config.load({"TIDELOG_CONFIG": named}, tmp_path)


@pytest.mark.parametrize("mb,ok", [(0, False), (1, True), (64, True), (1024, True), (1025, False), (2048, False)])
def test_memtable_range(tmp_path, mb, ok):
    storage = config.Storage(str(tmp_path / "d"), mb)
    if ok:
        storage.validate()
    else:
        with pytest.raises(ConfigError):
            storage.validate()


def test_folder_not_writable(tmp_path):
    (tmp_path / "file").write_text("")
    with pytest.raises(ConfigError):
        config.Storage(str(tmp_path / "file" / "d")).validate()


@pytest.mark.parametrize("host", ["10.20.30.40", "198.51.100.7", "fe80::abcd", "::ffff:203.0.113.9"])
def test_hosts(host):
    config.Server(host).validate()


@pytest.mark.parametrize("host", ["db.internal", "10.20.30.400", "10.20", "fe80:::1", "10.0.0.1:80", " "])
def test_bad_hosts(host):
    with pytest.raises(ConfigError):
        config.Server(host).validate()


@pytest.mark.parametrize("port", [0, 65536, -1])
def test_bad_ports(port):
    with pytest.raises(ConfigError):
        config.Server(port=port).validate()


def test_global(monkeypatch, tmp_path):
    monkeypatch.setattr(config, "_config", None)
    with pytest.raises(RuntimeError):
        config.current()
    first = config.init({"TIDELOG__STORAGE__DATA_DIR": str(tmp_path)}, tmp_path)
    assert config.init({}, tmp_path) is first is config.current()
