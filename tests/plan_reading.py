"""Reading physical plans."""


def exchanged_columns(df) -> list[list[str]]:
    """Names of the columns that each shuffle or broadcast of the plan moves, as planned."""
    found = []

    def walk(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            walk(node.executedPlan())
            return
        if "Exchange" in name:
            output = node.output()
            found.append([output.apply(i).name() for i in range(output.size())])
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def python_functions(df) -> int:
    """Steps of the plan that call Python, each of which takes workers of its own."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
