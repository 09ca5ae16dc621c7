import pytest

from keyloom.plans.samples import Counter, functional_counter, putter
from keyloom.sources.adaptors import DispatcherAdaptor
from keyloom.topology import Cluster, ClusterId, Node, Topology, TopologyError


def base():
    return Node.builder("app").default_routing("managed").receiver()


def test_a_node_is_built():
    node = base().cluster("source").adaptor(DispatcherAdaptor()).cluster("count").mp(Counter()).output_every(1).evict_every(5).conf("threading.max_pending", "10").build()
    assert [c.name for c in node.clusters] == ["source", "count"]
    assert node.clusters[1].routing == "managed" and node.settings["threading.max_pending"] == 10
    assert node.clusters[1].warnings() == ["count: eviction is on, but nothing says when"]


@pytest.mark.parametrize(
    ("build", "said"),
    [
        (lambda: base().build(), "a cluster at least"),
        (lambda: base().mp(Counter()), "name a cluster first"),
        (lambda: base().cluster("c").build(), "either a processor or an adaptor"),
        (lambda: base().cluster("c").mp(Counter()).adaptor(1).build(), "either a processor or an adaptor"),
        (lambda: base().cluster("c").mp(Counter()).cluster("c").mp(Counter()).build(), "one name"),
        (lambda: base().cluster("c").adaptor(1).key_source(list).build(), "no key source"),
        (lambda: Node.builder("app").receiver().cluster("c").mp(Counter()).build(), "routing strategy"),
        (lambda: Node.builder("app").default_routing("managed").cluster("c").mp(Counter()).build(), "receiver"),
        (lambda: Node.builder("a/b").receiver().cluster("c").adaptor(1).build(), "without slashes"),
        (lambda: base().cluster("c").mp(object()), "not marked"),
        (lambda: base().cluster("c").mp(Counter()).routing("none").build(), "no router"),
        (lambda: base().cluster("c:d").mp(Counter()).build(), ":"),
        (lambda: base().cluster("c").mp(Counter()).conf("none", 1), "no setting"),
        (lambda: base().cluster("c").mp(Counter()).conf("router.managed.total_shards", 100).build(), "power of two"),
        (lambda: base().cluster("c").mp(Counter()).max_pending(5).build(), "its own queue"),
        (lambda: base().cluster("c").mp(Counter()).container("none").build(), "no container"),
    ],
)
def test_what_is_wrong_is_said(build, said):
    with pytest.raises(TopologyError, match=said):
        build()


def test_ids():
    assert str(ClusterId("a", "b")) == "a:b" and ClusterId.parse("a:b") == ClusterId("a", "b")
    with pytest.raises(NotImplementedError):
        Cluster("c").destinations("d")


def test_types_make_the_graph():
    node = base().cluster("count").mp(functional_counter()).cluster("put").mp(putter()).cluster("again").mp(putter()).build()
    t = Topology(node)
    assert t.receivers == {"event": ["count"], "counted": ["put", "again"]}
    assert t.to(["counted", "none", "counted"]) == ["put", "again", "put", "again"]
    assert t.order({"count": ["counted"]}).index("count") < t.order({"count": ["counted"]}).index("put")


def test_feedback_is_named():
    node = base().cluster("count").mp(functional_counter()).cluster("put").mp(putter()).build()
    with pytest.raises(TopologyError, match="count -> put -> count"):
        Topology(node).order({"count": ["counted"], "put": ["event"]})
