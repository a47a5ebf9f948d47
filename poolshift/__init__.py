"""poolshift: deployment-inventory analytics as Spark DataFrame plans.

Main entry points::

    from poolshift.session import build_session
    from poolshift.sources.inventory import read_inventory, normalise_inventory
    from poolshift.operators.migration import migration            # lender -> receiver
    from poolshift.operators.scaling import recommend_scale_down   # scale-down advice
    from poolshift.operators.migratable import migratable_services # other pools of a pool's services
    from poolshift.operators.candidates import compare_candidates  # one lender, many candidates
    from poolshift.operators.batch import migration_batch          # many requests in one plan
    from poolshift.streaming.requests import answer_requests       # requests arriving as files
"""

__version__ = "0.1.0"
